"""Column statistics with type inference, type overrides, facets, and data quality."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.running import store

SAMPLE_ROWS = 5000
FACET_VALUES = 6
FACET_BINS = 6
DISTINCT_CAP = 10_000


def _is_null(t: Column) -> Column:
    return F.lower(S.trim_all(t)).isin(*S.TYPE_NULLS)


def long_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(slot, value): every cell as text, one row per column and row."""
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), S.text(df, c).alias("value")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("c")).select("c.slot", "c.value")


def column_statistics(df: DataFrame, columns: list[str] | None = None, order: str | None = None, sample: int | None = SAMPLE_ROWS) -> DataFrame:
    """Per column: counts, inferred type, numeric summary over a sample of the first rows.

    Cells are counted once per distinct value, so date patterns run on distinct
    values only.
    """
    columns = columns or [c for c in df.columns if c != order]
    if sample is not None and order:
        df = df.orderBy(order).limit(sample)
    counts = long_cells(df, columns).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value")
    t = S.trim_all(v)
    x = F.when(~S.identifier_like(t), S.finite(S.parse_number(v)))
    marked = counts.select("slot", "n", t.alias("t"), _is_null(v).alias("missing"), x.alias("x"),
                           S.parse_date(v).isNotNull().alias("is_date"), F.lower(t).isin(*S.BOOLEANS).alias("is_bool"),
                           (x.isNotNull() & (x == F.floor(x)) & ~t.rlike("[.eE]")).alias("is_int"))
    there = ~F.col("missing")

    def every(flag: str) -> Column:
        return F.bool_and(F.when(there, F.col(flag)))

    w = F.when(there & F.col("x").isNotNull(), F.col("n"))
    stats = marked.groupBy("slot").agg(
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(F.lit(0))).alias("null_count"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("non_null_count"),
        F.count_distinct(F.when(there, F.col("t"))).alias("unique_count"), every("is_bool").alias("b"), every("is_date").alias("d"), every("is_int").alias("i"),
        F.bool_and(F.when(there, F.col("x").isNotNull())).alias("f"), F.min(F.when(there, F.col("x"))).alias("min"), F.max(F.when(there, F.col("x"))).alias("max"),
        (F.sum(F.col("x") * w) / F.sum(w)).alias("mean"), F.expr("percentile(x, 0.5, CASE WHEN NOT missing AND x IS NOT NULL THEN n ELSE 0 END)").alias("median"),
        (F.sum(F.col("x") * F.col("x") * w) / F.sum(w)).alias("m2"))
    kind = (F.when(F.col("non_null_count") == 0, "Empty").when(F.col("b"), "Boolean").when(F.col("d"), "Date").when(F.col("i"), "Integer").when(F.col("f"), "Float")
            .when(F.col("unique_count") <= F.greatest(F.lit(20), F.floor(F.col("non_null_count") / 2)), "Categorical").otherwise("String"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1)
    return stats.select("slot", names.alias("column"), kind.alias("type"), "null_count", "non_null_count", "unique_count", "min", "max", "mean", "median",
                        F.when(F.col("mean").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.col("m2") - F.col("mean") * F.col("mean")))).alias("std")).orderBy("slot")


def top_values(df: DataFrame, columns: list[str], k: int = 10, nulls: bool = False) -> DataFrame:
    """column, rank, value, count: each column's most frequent values."""
    cells = long_cells(df, columns)
    if not nulls:
        cells = cells.where(~_is_null(F.col("value")))
    counts = cells.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy("slot").orderBy(F.desc("count"), S.order_text(F.col("value")), "value")
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(names.alias("column"), "rank", "value", "count")


#: What a column of one type may be read as: allow, check on a sample, or block.
def override_rule(inferred: str, wanted: str) -> str:
    if inferred == wanted or wanted in ("String", "Categorical"):
        return "allow"
    if wanted == "Empty" or (inferred, wanted) == ("Float", "Integer"):
        return "block"
    return "allow" if (inferred, wanted) == ("Integer", "Float") else "validate"


def override_failures(df: DataFrame, column: str, wanted: str, sample: int = 2000, examples: int = 5) -> DataFrame:
    """Up to five of the most frequent values that can't be read as the wanted type."""
    v = F.col("value")
    x = S.parse_number(v)
    fits = {"Integer": (S.finite(x) == F.floor(S.finite(x))) & ~v.rlike("[.eE]"), "Float": x.isNotNull(),
            "Date": S.parse_date(v).isNotNull(), "Boolean": F.lower(S.trim_all(v)).isin(*S.BOOLEANS)}.get(wanted, F.lit(True))
    values = df.groupBy(S.text(df, column).alias("value")).agg(F.count(F.lit(1)).alias("count")).where(~_is_null(v))
    values = values.orderBy(F.desc("count"), "value").limit(sample)
    return values.where(~F.coalesce(fits, F.lit(False))).orderBy(F.desc("count"), "value").limit(examples)


def facet_counts(df: DataFrame, columns: list[str], base: Column | None = None, filters: dict[str, Column] | None = None) -> DataFrame:
    """(slot, value, count) in one pass; a column's own filter doesn't restrict its facet.

    A row counts for a column if every filter holds, or only that column's fails.
    """
    filters = filters or {}
    flags = {c: F.coalesce(p, F.lit(False)) for c, p in filters.items()}
    fails = reduce(Column.__add__, [(~p).cast("int") for p in flags.values()], F.lit(0))
    named = df.where(base) if base is not None else df
    kept = named.withColumn("__fails", fails).where("__fails <= 1")
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), S.text(df, c).alias("value"),
                               ((F.col("__fails") == 0) | (~flags[c] if c in flags else F.lit(False))).alias("counts")) for i, c in enumerate(columns)])
    rows = kept.select(F.explode(F.filter(cells, lambda x: x["counts"])).alias("c"))
    return rows.groupBy("c.slot", "c.value").agg(F.count(F.lit(1)).alias("count"))


def facet_top(df: DataFrame, columns: list[str], base: Column | None = None, filters: dict[str, Column] | None = None, k: int = FACET_VALUES) -> DataFrame:
    """column, rank, value, count, other_count, distinct_truncated; values trimmed of spaces and tabs."""
    counts = facet_counts(df, columns, base, filters)
    counts = counts.groupBy("slot", F.regexp_replace("value", r"^[ \t]+|[ \t]+$", "").alias("value")).agg(F.sum("count").alias("count"))
    counts = store(counts)
    totals = F.broadcast(counts.groupBy("slot").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("distinct")))  # a row per column
    own = Window.partitionBy("slot")
    order = own.orderBy(F.desc("count"), S.order_text(F.col("value")), "value")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)  # every task keeps its first k of a column
    top = top.join(totals, "slot")
    listed = F.sum("count").over(own)
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1)
    return top.select(names.alias("column"), "rank", "value", "count", (F.col("total") - listed).alias("other_count"),
                      (F.col("distinct") > DISTINCT_CAP).alias("distinct_truncated"))


def facet_histogram(df: DataFrame, column: str, base: Column | None = None, filters: dict[str, Column] | None = None, bins: int = FACET_BINS) -> DataFrame:
    """bin, lower, upper, count, numeric_count, non_numeric_count; empty where top values serve better."""
    counts = facet_counts(df, [column], base, filters)
    x = S.finite(S.parse_number(F.col("value")))
    cells = counts.select(x.alias("x"), "count", (S.trim_all(F.col("value")) == "").alias("blank"))
    bounds = cells.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("x").alias("d"), F.coalesce(F.sum(F.when(F.col("x").isNotNull(), F.col("count"))), F.lit(0)).alias("numeric_count"),
                       F.coalesce(F.sum(F.when(F.col("x").isNull() & ~F.col("blank"), F.col("count"))), F.lit(0)).alias("non_numeric_count"))
    bounds = F.broadcast(bounds.where((F.col("d") > bins) & (F.col("lo") < F.col("hi"))).withColumn("w", (F.col("hi") - F.col("lo")) / bins))  # one row
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), ((F.col("x") - F.col("lo")) / F.col("w")).cast("int")))
    binned = cells.where("x IS NOT NULL").join(bounds).groupBy(place.alias("bin")).agg(F.sum("count").alias("count"))
    frame = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame.join(binned, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("lower"),
                                                    (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("upper"), F.coalesce("count", F.lit(0)).alias("count"),
                                                    "numeric_count", "non_numeric_count").orderBy("bin")


def key_like(name: str) -> bool:
    """Whether a header reads as a key: a key word alone, a last word id, a capitalised Id or ID at the end, or a number word."""
    return name.lower() in ("id", "key", "code", "uuid") or re.search(r"[_\- ]id$", name.lower()) is not None or name.endswith(("Id", "ID")) or "번호" in name


def quality_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(slot, value, n, kind, t): each distinct cell value with its kind: blank, sentinel, number, date or text."""
    counts = long_cells(df, columns).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    t = F.regexp_replace("value", r"^[ \t]+|[ \t]+$", "")
    x = F.when(~S.identifier_like(t), S.finite(S.parse_number(t)))
    kind = (F.when(t == "", "blank").when(F.lower(t).isin(*S.QUALITY_SENTINELS), "sentinel").when(x.isNotNull(), "number")
            .when(S.parse_date(t).isNotNull(), "date").otherwise("text"))
    return counts.select("slot", "value", "n", kind.alias("kind"))


def quality_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: counts by kind, distinct values, dominant type, issue counts, codebook flag."""
    cells = quality_counts(df, columns)

    def n(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    valued = F.col("kind").isin("number", "date", "text")
    out = cells.groupBy("slot").agg(F.sum("n").alias("total"), n("blank").alias("blank"), n("sentinel").alias("sentinel"), n("number").alias("numeric"),
                                    n("date").alias("date"), n("text").alias("text"), F.coalesce(F.sum(valued.cast("long")), F.lit(0)).alias("distinct_count"),
                                    F.coalesce(F.sum((valued & (F.col("n") > 1)).cast("long")), F.lit(0)).alias("repeated_values"),
                                    F.coalesce(F.sum(((F.col("kind") != "blank") & (F.col("n") > 1)).cast("long")), F.lit(0)).alias("repeated_keys"))
    values = F.col("numeric") + F.col("date") + F.col("text")
    kind = F.when(values == 0, "Empty").when(F.col("numeric") * 5 >= values * 3, "Numeric").when(F.col("date") * 5 >= values * 3, "Date").otherwise("Text")
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1)
    is_key = F.element_at(F.array(*[F.lit(key_like(c)) for c in columns]), F.col("slot") + 1)
    invalid = F.when(kind == "Numeric", values - F.col("numeric")).when(kind == "Date", values - F.col("date")).otherwise(0)
    return out.select("slot", names.alias("column"), "total", "blank", "sentinel", "numeric", "date", "text", "distinct_count", kind.alias("type"),
                      (F.col("blank") * 2 > F.col("total")).alias("blank_rate"), (F.col("sentinel") > 0).alias("has_sentinel"), invalid.alias("invalid"),
                      F.when(is_key & (F.col("total") - F.col("blank") > 1), F.col("repeated_keys")).otherwise(0).alias("duplicate_keys"),
                      (F.col("distinct_count").between(2, 20) & (F.col("repeated_values") > 0)).alias("has_codebook")).orderBy("slot")


def quality_codebook(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, count of columns with 2 to 20 distinct values, one of them repeated."""
    cells = quality_counts(df, columns).where("kind IN ('number', 'date', 'text')")
    fits = cells.groupBy("slot").agg(F.count(F.lit(1)).alias("d"), F.max("n").alias("most")).where("d BETWEEN 2 AND 20 AND most > 1")
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("slot") + 1)
    return cells.join(fits, "slot").select(names.alias("column"), "value", F.col("n").alias("count")).orderBy("column", F.desc("count"), "value")


def duplicate_row_count(df: DataFrame, columns: list[str]) -> DataFrame:
    """rows, duplicates: rows beyond the first of each distinct row."""
    groups = df.groupBy(*[S.text(df, c).alias(f"k{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def quality_issues(df: DataFrame, columns: list[str], ragged: Column | None = None) -> DataFrame:
    """kind, severity, column, count: every issue found."""
    p = quality_profile(df, columns)
    issue = [F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.when(cond, n.cast("long")).alias("count")) for k, s, cond, n in (
        ("blankRate", "warning", F.col("blank_rate"), F.col("blank")), ("sentinel", "warning", F.col("has_sentinel"), F.col("sentinel")),
        ("typeValidity", "warning", F.col("invalid") > 0, F.col("invalid")), ("keyUniqueness", "error", F.col("duplicate_keys") > 0, F.col("duplicate_keys")))]
    out = p.select("column", F.explode(F.array(*issue)).alias("i")).select("i.kind", "i.severity", "column", "i.count").where("count IS NOT NULL")
    same = duplicate_row_count(df, columns).where("duplicates > 0")
    out = out.unionByName(same.select(F.lit("duplicateRows").alias("kind"), F.lit("info").alias("severity"), F.lit("").alias("column"), F.col("duplicates").alias("count")))
    if ragged is not None:
        bad = df.agg(F.count_if(ragged).alias("count")).where("count > 0")
        out = out.unionByName(bad.select(F.lit("raggedRow").alias("kind"), F.lit("error").alias("severity"), F.lit("").alias("column"), "count"))
    return out


def quality_score(df: DataFrame, columns: list[str], ragged: Column | None = None) -> DataFrame:
    """score: 100 less penalties for missing cells and issues, as a whole number from 0 to 100."""
    p = quality_profile(df, columns)
    missing = (F.col("blank") + F.col("sentinel")) / F.col("total")
    bad = F.count_if(ragged) if ragged is not None else F.lit(0)
    rows = F.broadcast(df.agg(F.count(F.lit(1)).alias("rows"), bad.alias("bad")))  # one row
    values = F.greatest(F.col("total") - F.col("blank") - F.col("sentinel"), F.lit(1))
    lost = (F.sum(missing * 20 / len(columns))
            + F.sum(F.when(F.col("invalid") > 0, F.least(F.lit(15.0), F.col("invalid") / values * 100 * 3)).otherwise(0.0))
            + F.sum(F.when(F.col("duplicate_keys") > 0, 15.0).otherwise(0.0)))
    out = p.agg(F.coalesce(lost, F.lit(0.0)).alias("lost")).join(rows)
    penalty = F.col("lost") + F.when(F.col("bad") > 0, F.least(F.lit(20.0), F.col("bad") / F.col("rows") * 100 * 4)).otherwise(0.0)
    return out.select(F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - penalty).cast("int"))).alias("score"))


def score_light(score: int) -> str:
    """Traffic light of a score."""
    return "green" if score >= 90 else "yellow" if score >= 70 else "orange" if score >= 50 else "red"
