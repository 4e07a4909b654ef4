"""Group-by, distinct values, duplicates, distributions, date histograms, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.running import cumulate, positions, quantiles, store

FUNCTIONS = ("count", "sum", "mean", "median", "min", "max", "unique", "std")
JOINER = "\x1f"
#: A pivot fills every row's missing cells, so its columns are bounded.
PIVOT_COLUMNS = 16_384


def measure(df: DataFrame, column: str, function: str) -> Column:
    """One of FUNCTIONS over a column; numeric functions of no numbers give 0."""
    if function == "count":
        return F.count(F.lit(1))
    if function == "unique":
        return F.count_distinct(S.text(df, column))
    x = S.number(df, column)
    out = {"sum": F.sum(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "median": F.percentile(x, 0.5), "std": F.stddev_pop(x)}[function]
    return F.coalesce(out, F.lit(0.0))


def group_by(df: DataFrame, keys: list[str], column: str, functions=FUNCTIONS) -> DataFrame:
    """Groups by exact text keys with the chosen functions, in key order ignoring case."""
    named = [S.text(df, k).alias(k) for k in keys]
    out = df.groupBy(*named).agg(*[measure(df, column, f).alias(f) for f in functions if f != "median"], F.count(F.lit(1)).alias("__rows"))
    if "median" in functions:  # ranks over range partitions: a group's numbers are never held in one place
        middle = quantiles(df.select(*named, S.number(df, column).alias("__v")), keys, "__v", (0.5,)).select(*keys, F.get("q", F.lit(0)).alias("median"))
        out = out.join(middle, keys, "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    out = out.select(*keys, *functions)
    return out.orderBy(S.order_text(F.concat_ws(JOINER, *keys)), *keys)


def distinct_values(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """value, count; most frequent first, then by text."""
    out = df.groupBy(S.text(df, column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    out = out.orderBy(F.desc("count"), S.order_text(F.col("value")), "value")
    return out.limit(limit) if limit else out


def duplicate_groups(df: DataFrame, keys: list[str], row_col: str) -> DataFrame:
    """Key values seen more than once: count, first row, and member rows in order."""
    out = df.groupBy(*[S.text(df, k).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("count"), F.min(row_col).alias("first_row"), F.array_sort(F.collect_list(row_col)).alias("rows"))
    return out.where("count > 1").orderBy("first_row")


def duplicate_rows(df: DataFrame, keys: list[str], row_col: str) -> DataFrame:
    """Members of duplicate groups, one row each: no group is gathered in one place."""
    named = [S.text(df, k).alias(k) for k in keys]
    groups = df.groupBy(*named).agg(F.count(F.lit(1)).alias("count"), F.min(row_col).alias("first_row")).where("count > 1")
    return df.select(*named, F.col(row_col).alias("row")).join(groups, keys)


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    """One row over finite numbers: count, min, max, mean, median, q1, q3, population std."""
    x = S.finite(S.number(df, column))
    one = df.agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    q = quantiles(df.select(x.alias("x")), [], "x", (0.25, 0.5, 0.75)).select("q")
    return one.join(F.broadcast(q), F.lit(True), "left").select(  # one row each
        "count", "min", "max", "mean", F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(2)).alias("q3"), "std")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over finite numbers: bin, lower, upper, count; empty bins stay; a constant has one bin."""
    x = S.finite(S.number(df, column))
    values = df.select(x.alias("x")).where("x IS NOT NULL")
    bounds = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo IS NOT NULL")
    n = F.when(F.col("lo") == F.col("hi"), 1).otherwise(bins)
    width = F.when(F.col("lo") == F.col("hi"), 0.0).otherwise((F.col("hi") - F.col("lo")) / bins)
    bounds = bounds.select("lo", "hi", n.alias("n"), width.alias("w"))
    place = F.when(F.col("w") == 0, 0).otherwise(F.least(F.col("n") - 1, F.greatest(F.lit(0), ((F.col("x") - F.col("lo")) / F.col("w")).cast("int"))))
    counts = values.join(F.broadcast(bounds)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))  # bounds is one row
    frame = bounds.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bin"))
    lower = F.col("lo") + F.col("bin") * F.col("w")
    upper = F.when(F.col("bin") == F.col("n") - 1, F.col("hi")).otherwise(lower + F.col("w"))
    return frame.join(counts, "bin", "left").select("bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin")


def date_histogram(df: DataFrame, column: str, unit: str = "month", value: str | None = None) -> DataFrame:
    """label, count, and with a value column sum and average, whose denominator is all dated rows."""
    rows = df.select(S.date(df, column).alias("d"), *([F.coalesce(S.number(df, value), F.lit(0.0)).alias("v")] if value else [])).where("d IS NOT NULL")
    aggs = [F.count(F.lit(1)).alias("count")]
    if value:
        aggs += [F.sum("v").alias("sum"), (F.sum("v") / F.count(F.lit(1))).alias("average")]
    return rows.groupBy(S.date_label(F.col("d"), unit).alias("label")).agg(*aggs).orderBy("label")


def pivot_key(df: DataFrame, column: str, unit: str | None = None) -> Column:
    """A pivot cell's key: null tokens as ``null``; dates by label where a unit is given."""
    plain = S.null_key(F.col(column))
    if not unit:
        return plain
    return F.coalesce(S.date_label(S.date(df, column), unit), plain)


def pivot(df: DataFrame, rows: list[str], columns: list[str], value: str, function: str = "sum", filters: dict[str, str] | None = None,
          units: dict[str, str] | None = None) -> DataFrame:
    """Long form: row_key, column_key, value for every pair of keys; a missing cell is 0."""
    units = units or {}
    for name, wanted in (filters or {}).items():
        df = df.where(pivot_key(df, name, units.get(name)) == wanted)

    def joined(names: list[str]) -> Column:
        return F.concat_ws(JOINER, *[pivot_key(df, c, units.get(c)) for c in names])

    cells = df.groupBy(joined(rows).alias("row_key"), joined(columns).alias("column_key")).agg(measure(df, value, function).cast("double").alias("value"))
    cells = store(cells)
    columns_there = cells.select("column_key").distinct()
    n = columns_there.limit(PIVOT_COLUMNS + 1).count()
    if n > PIVOT_COLUMNS:
        raise ValueError(f"a pivot of more than {PIVOT_COLUMNS} columns")
    frame = cells.select("row_key").distinct().join(F.broadcast(columns_there))  # at most PIVOT_COLUMNS rows
    return frame.join(cells, ["row_key", "column_key"], "left").fillna(0.0, ["value"]).orderBy("row_key", "column_key")


def pivot_measures(df: DataFrame, rows: list[str], columns: list[str], measures: list[tuple[str, str]], **how) -> DataFrame:
    """Several measures: ``pivot`` of each, with a measure column."""
    out = None
    for value, function in measures:
        part = pivot(df, rows, columns, value, function, **how).select(F.lit(f"{function}({value})").alias("measure"), "row_key", "column_key", "value")
        out = part if out is None else out.unionByName(part)
    return out


def pivot_wide(long: DataFrame, columns: list[str]) -> DataFrame:
    """One column per given column key."""
    return long.groupBy("row_key").pivot("column_key", columns).agg(F.first("value")).fillna(0.0).orderBy("row_key")


def pivot_totals(long: DataFrame) -> DataFrame:
    """Totals of a long pivot: sums of its displayed cells, whatever the function."""
    by_row = long.groupBy(F.lit("row").alias("kind"), F.col("row_key").alias("key")).agg(F.sum("value").alias("total"))
    by_column = long.groupBy(F.lit("column").alias("kind"), F.col("column_key").alias("key")).agg(F.sum("value").alias("total"))
    grand = long.agg(F.sum("value").alias("total")).select(F.lit("grand").alias("kind"), F.lit("").alias("key"), "total")
    return by_row.unionByName(by_column).unionByName(grand)


def pivot_filter_values(df: DataFrame, column: str, order: str, unit: str | None = None, row_limit: int | None = 50_000, limit: int | None = 500) -> DataFrame:
    """Keys offered as filters: those in the first rows of the view, or in all rows without a limit, in text order."""
    head = df if row_limit is None else df.orderBy(order).limit(row_limit)
    values = head.select(pivot_key(head, column, unit).alias("value")).distinct().orderBy("value")
    return values if limit is None else values.limit(limit)


def frequency(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """rank, value, count, percent, cumulative percent; blanks last; the cumulative runs over the listed rows."""
    counts = df.groupBy(S.text(df, column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    order = [(F.col("value") == "").cast("int"), F.desc("count"), S.order_text(F.col("value")), F.col("value")]
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("total")))  # one row
    if limit:
        listed = counts.orderBy(*order).limit(limit)
        window = Window.orderBy(*order)  # over ``limit`` rows
        listed = listed.select("value", "count", (F.row_number().over(window)).alias("rank"), F.sum("count").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    else:
        ranked = positions(counts, order, "at")
        listed = cumulate(ranked, [], ["at"], "count").select("value", "count", (F.col("at") + 1).alias("rank"), (F.col("before") + F.col("count")).alias("upto"))
    return listed.join(total).select("rank", "value", "count", (F.col("count") / F.col("total") * 100).alias("percent"),
                                     (F.col("upto") / F.col("total") * 100).alias("cumulative_percent")).orderBy("rank")


def pareto(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """The most frequent non-blank values with cumulative percent of all non-blank cells."""
    rows = df.where(S.text(df, column) != "")
    return frequency(rows, column, limit).select("rank", "value", "count", "cumulative_percent")
