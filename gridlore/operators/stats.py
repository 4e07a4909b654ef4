"""Descriptive statistics and tests: Spark sums what they need, the driver ends them."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tails
from ..functions.running import cumulate, store

SIGNIFICANT = 0.05
#: Modes listed in a descriptive row; ``modes`` gives all.
MODES = 20
#: A contingency table lists every pair of categories, so one side is bounded.
CATEGORIES = 16_384


def interpretation(p: float) -> str:
    return "statistically significant (p < 0.05)" if p < SIGNIFICANT else "not statistically significant (p >= 0.05)"


@dataclass(frozen=True)
class Test:
    name: str
    statistic: float
    df: float
    p: float
    extra: dict = field(default_factory=dict)

    @property
    def text(self) -> str:
        return interpretation(self.p)


TEST_ROW = "name string, n long, statistic double, df double, df2 double, p double, difference double, ci_low double, ci_high double, effect double, verdict string"


def test_row(spark: SparkSession, test: Test) -> DataFrame:
    """A test as a table of one row; what a test doesn't have is null."""
    low, high = test.extra.get("ci", (None, None))
    n, df2, effect = test.extra.get("n"), test.extra.get("df2"), test.extra.get("effect", test.extra.get("eta_squared"))
    numbers = [None if v is None else float(v) for v in (test.statistic, test.df, df2, test.p, test.extra.get("difference"), low, high, effect)]
    return spark.createDataFrame([(test.name, None if n is None else int(n), *numbers, test.extra.get("note") or test.text)], TEST_ROW)


def descriptive(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, missing, mean with its 95 % interval, sd, se, min, quartiles, max, range, iqr, skew, kurtosis, cv, modes.

    Moments take one pass; quartiles and modes come from the counts of distinct numbers.
    """
    aggs = []
    for i, c in enumerate(columns):
        x = S.finite(S.number(df, c))
        aggs.append(F.struct(F.lit(i).alias("slot"), F.lit(c).alias("column"), F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), F.avg(x).alias("mean"),
                             F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"),
                             F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2")).alias(f"s{i}"))
    rows = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(columns))])).alias("s")).select("s.*")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), S.finite(S.number(df, c)).alias("x")) for i, c in enumerate(columns)])).alias("s")).select("s.*").where("x IS NOT NULL")
    counts = store(cells.groupBy("slot", "x").agg(F.count(F.lit(1)).alias("c")))
    placed = cumulate(counts, ["slot"], ["x"], "c")
    rows = rows.join(F.broadcast(_quartiles(placed)), "slot", "left").join(F.broadcast(_modes(counts)), "slot", "left")  # a row per column
    criticals = {r["n"]: tails.t_critical(r["n"] - 1) for r in rows.select("n").distinct().collect() if r["n"] > 1}  # a row per column
    critical = F.coalesce(F.element_at(F.create_map(*[F.lit(z) for pair in criticals.items() for z in pair]).cast("map<bigint,double>"), F.col("n")), F.lit(0.0)) if criticals else F.lit(0.0)
    n = F.col("n").cast("double")
    flat = F.coalesce(F.col("sd"), F.lit(0.0)) == 0
    skew = F.when((n > 2) & ~flat, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when((n > 3) & ~flat, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    q = [F.get("q", F.lit(i)) for i in range(3)]
    se = F.when(n > 0, F.col("sd") / F.sqrt(n))
    return rows.select("slot", "column", "n", "missing", "mean", "sd", se.alias("se"), (F.col("mean") - critical * se).alias("ci_low"),
                       (F.col("mean") + critical * se).alias("ci_high"), "min", q[0].alias("q1"), q[1].alias("median"),
                       q[2].alias("q3"), "max", (F.col("max") - F.col("min")).alias("range"), (q[2] - q[0]).alias("iqr"), skew.alias("skewness"), kurt.alias("kurtosis"),
                       F.when(F.col("mean") == 0, 0.0).otherwise(F.col("sd") / F.col("mean")).alias("cv"),
                       F.coalesce("modes", F.expr("cast(array() as array<double>)")).alias("modes"), F.coalesce("mode_count", F.lit(0)).alias("mode_count")).orderBy("slot").drop("slot")


def _quartiles(placed: DataFrame) -> DataFrame:
    """slot, q of running counts (slot, x, c, before)."""
    sizes = F.broadcast(placed.groupBy("slot").agg(F.sum("c").alias("total")))  # a row per column
    both = placed.join(sizes, "slot")
    ranks = [(F.col("total") - 1) * p for p in (0.25, 0.5, 0.75)]

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("c")), F.col("x")))

    ends = both.groupBy("slot", "total").agg(*[at(F.floor(r)).alias(f"l{i}") for i, r in enumerate(ranks)], *[at(F.ceil(r)).alias(f"h{i}") for i, r in enumerate(ranks)])
    return ends.select("slot", F.array(*[F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (r - F.floor(r)) for i, r in enumerate(ranks)]).alias("q"))


def _modes(counts: DataFrame, most: int = MODES) -> DataFrame:
    """slot, modes, mode_count: the first ``most`` values of the highest count, none if no value repeats."""
    best = F.broadcast(counts.groupBy("slot").agg(F.max("c").alias("mode_count")).where("mode_count > 1"))  # a row per column
    top = counts.join(best, "slot").where("c = mode_count")
    ranked = top.withColumn("r", F.row_number().over(Window.partitionBy("slot").orderBy("x"))).where(F.col("r") <= most)
    return ranked.groupBy("slot", "mode_count").agg(F.array_sort(F.collect_list("x")).alias("modes"))  # at most ``most`` values


def confidence_interval(mean: float, se: float, n: int, level: float = 0.95) -> tuple[float, float]:
    half = tails.t_critical(n - 1, level) * se if n > 1 else 0.0
    return mean - half, mean + half


def modes(df: DataFrame, column: str) -> DataFrame:
    """All values of the highest count; none if no value repeats."""
    x = S.finite(S.number(df, column))
    counts = df.select(x.alias("mode")).where("mode IS NOT NULL").groupBy("mode").agg(F.count(F.lit(1)).alias("count"))
    best = F.broadcast(counts.agg(F.max("count").alias("best")))  # one row
    return counts.join(best).where("count = best AND count > 1").select("mode", "count").orderBy("mode")


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(S.finite(S.number(df, x)).alias("x"), S.finite(S.number(df, y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """n, r over finite pairs; r is 0 without variance."""
    rows = _pairs(df, x, y)
    if method == "spearman":
        rows = ranked(rows)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("r"))


def ranked(rows: DataFrame) -> DataFrame:
    """x and y replaced by average ranks.

    Ranks come from counts of distinct values, numbered by running sums over
    range-partitioned values, so no task gets all rows.
    """
    return average_ranks(average_ranks(rows, "x"), "y")


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    table = cumulate(counts, [], ["v"], "c").select("v", (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))
    other = [c for c in rows.columns if c != column]
    return rows.join(table, rows[column] == table["v"]).select(F.col("rank").alias(column), *other)


def correlation_test(df: DataFrame, x: str, y: str, method: str = "pearson") -> Test:
    row = correlation(df, x, y, method).first()
    n, r = row["n"], row["r"] if row["n"] > 1 else 0.0
    if n <= 2:
        return Test(method, r, n - 2, 1.0, {"n": n})
    if abs(r) >= 1:
        return Test(method, r, n - 2, 0.0, {"n": n})
    return Test(method, r, n - 2, tails.t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), {"n": n})


def group_moments(df: DataFrame, group: str, value: str, order: str | None = None) -> DataFrame:
    """group, n, mean, variance (sample, 0 for one value) of finite values."""
    x = S.finite(S.number(df, value))
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).cast("string").alias("grp"), x.alias("x"), *([F.col(order).alias("o")] if order else [])).where("x IS NOT NULL")
    out = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"),
                                  F.min("o" if order else "grp").alias("first"))
    return out.orderBy("first").select(F.col("grp").alias("group"), "n", "mean", "variance")


def welch_from(a: tuple[int, float, float], b: tuple[int, float, float]) -> Test:
    """Welch's test from (n, mean, variance) of two groups."""
    (na, ma, va), (nb, mb, vb) = a, b
    diff = ma - mb
    ea, eb = (va / na if na else 0.0), (vb / nb if nb else 0.0)
    se = math.sqrt(ea + eb)
    low = (ea * ea / (na - 1) if na > 1 else 0.0) + (eb * eb / (nb - 1) if nb > 1 else 0.0)
    df = (ea + eb) ** 2 / low if low > 0 else na + nb - 2
    t = diff / se if se > 0 else 0.0
    pooled = math.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) if na + nb > 2 else 0.0
    half = tails.t_critical(df) * se
    return Test("welch", t, df, tails.t_two_sided(t, df), {"difference": diff, "ci": (diff - half, diff + half), "effect": diff / pooled if pooled > 0 else 0.0, "n": na + nb})


def welch_test(df: DataFrame, group: str, a: str, b: str, value: str) -> Test:
    rows = {r["group"]: (r["n"], r["mean"], r["variance"]) for r in group_moments(df.where(F.col(group).cast("string").isin(a, b)), group, value).collect()}
    return welch_from(rows.get(a, (0, 0.0, 0.0)), rows.get(b, (0, 0.0, 0.0)))


def paired_moments(df: DataFrame, before: str, after: str) -> DataFrame:
    return _pairs(df, before, after).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - F.col("x")).alias("mean"), F.coalesce(F.stddev_samp(F.col("y") - F.col("x")), F.lit(0.0)).alias("sd"))


def paired_test(df: DataFrame, before: str, after: str) -> Test:
    r = paired_moments(df, before, after).first()
    n, mean, sd = r["n"], r["mean"] or 0.0, r["sd"]
    se = sd / math.sqrt(n) if n else 0.0
    t = mean / se if se > 0 else 0.0
    half = tails.t_critical(n - 1) * se if n > 1 else 0.0
    return Test("paired", t, n - 1, tails.t_two_sided(t, n - 1), {"difference": mean, "ci": (mean - half, mean + half), "effect": mean / sd if sd > 0 else 0.0, "n": n})


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """row, column, observed, expected for every pair of categories."""
    kept = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    cells = kept.groupBy(S.text(df, rows).alias("row"), S.text(df, columns).alias("column")).agg(F.count(F.lit(1)).alias("observed"))
    cells = store(cells)
    by_row = cells.groupBy("row").agg(F.sum("observed").alias("rt"))
    by_column = cells.groupBy("column").agg(F.sum("observed").alias("ct"))
    total = F.broadcast(cells.agg(F.sum("observed").alias("total")))  # one row
    if by_column.limit(CATEGORIES + 1).count() > CATEGORIES:
        raise ValueError(f"a table of more than {CATEGORIES} columns")
    frame = by_row.join(F.broadcast(by_column)).join(total)  # at most CATEGORIES rows
    return frame.join(cells, ["row", "column"], "left").select("row", "column", F.coalesce("observed", F.lit(0)).alias("observed"),
                                                              (F.col("rt") * F.col("ct") / F.col("total")).alias("expected")).orderBy("row", "column")


def chi_square(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """statistic, df, n of a test of independence, from the cells that hold rows: n (sum o^2 / (r c) - 1)."""
    kept = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    cells = store(kept.groupBy(S.text(df, rows).alias("row"), S.text(df, columns).alias("column")).agg(F.count(F.lit(1)).alias("o")))
    by_row = cells.groupBy("row").agg(F.sum("o").alias("rt"))
    by_column = cells.groupBy("column").agg(F.sum("o").alias("ct"))
    share = F.col("o") * F.col("o") / (F.col("rt") * F.col("ct"))
    out = cells.join(by_row, "row").join(by_column, "column").agg(F.sum(share).alias("s"), F.coalesce(F.sum("o"), F.lit(0)).alias("n"),
                                                                  ((F.count_distinct("row") - 1) * (F.count_distinct("column") - 1)).alias("df"))
    return out.select(F.coalesce(F.greatest(F.lit(0.0), F.col("n") * (F.col("s") - 1)), F.lit(0.0)).alias("statistic"), "df", "n")


def chi_square_test(df: DataFrame, rows: str, columns: str) -> Test:
    r = chi_square(df, rows, columns).first()
    return Test("chi-square", r["statistic"], r["df"], tails.chi_square_above(r["statistic"], r["df"]), {"n": r["n"]})


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """k, n, between, within, f, eta_squared of a one-way analysis, in one row."""
    g = group_moments(df, group, value)
    total = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    both = g.select("n", "mean", "variance").withColumnRenamed("n", "gn").join(F.broadcast(total))  # total is one row
    gap = F.col("mean") - F.col("grand")
    sums = both.groupBy("k", "n").agg(F.sum(F.col("gn") * gap * gap).alias("between"), F.sum((F.col("gn") - 1) * F.col("variance")).alias("within"))
    usable = (F.col("k") >= 2) & (F.col("n") > F.col("k"))
    f = F.when(~usable, 0.0).when(F.col("within") == 0, F.when(F.col("between") > 0, float("inf")).otherwise(0.0)).otherwise(
        F.expr("try_divide(between / (k - 1), within / (n - k))"))
    every = F.col("between") + F.col("within")
    return sums.select("k", "n", "between", "within", f.alias("f"), F.when(every > 0, F.col("between") / every).otherwise(0.0).alias("eta_squared"))


def anova_test(df: DataFrame, group: str, value: str) -> Test:
    r = anova(df, group, value).first()
    if not r or r["k"] < 2 or r["n"] <= r["k"]:
        return Test("anova", 0.0, 0, 1.0)
    d1, d2 = r["k"] - 1, r["n"] - r["k"]
    return Test("anova", r["f"], d1, tails.f_above(r["f"], d1, d2), {"df2": d2, "eta_squared": r["eta_squared"], "n": r["n"]})


def shapiro_test(df: DataFrame, column: str, order: list[Column] | None = None, cap: int = 5000) -> Test:
    """Shapiro-Wilk on at most ``cap`` values, taken at equal strides of the order."""
    from .sorting import stride_sample

    x = S.finite(S.number(df, column))
    rows = df.where(x.isNotNull()).select(x.alias("x"), *([o.alias(f"o{i}") for i, o in enumerate(order)] if order else []))
    sample = stride_sample(rows, [F.col(f"o{i}") for i in range(len(order))] if order else ["x"], cap)
    values = sorted(r["x"] for r in sample.select("x").collect())  # at most cap values
    w, p, note = tails.shapiro_wilk(values)
    return Test("shapiro-wilk", w, len(values), p, {"note": note, "n": len(values)})
