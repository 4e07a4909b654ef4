"""Datasets for charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.running import quantiles
from . import aggregate, sorting

KDE_POINTS = 128
KDE_ROWS = 20_000
OUTLIERS = 200
SCATTER_POINTS = 20_000
GRID = (64, 48)
QQ_POINTS = 2000


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(S.finite(S.number(df, column)).alias("x")).where("x IS NOT NULL")


def kde(df: DataFrame, column: str, points: int = KDE_POINTS, cap: int = KDE_ROWS) -> DataFrame:
    """x, density on a grid from min to max; Gaussian kernel, Silverman's bandwidth.

    Values are sampled to ``cap`` and repeated ones counted first, so the sum runs
    over at most points * cap pairs.
    """
    values = sorting.stride_sample(_values(df, column).withColumn("tie", F.monotonically_increasing_id()), ["x", "tie"], cap).select("x")
    counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    q = F.broadcast(quantiles(values, [], "x", (0.25, 0.75)).select("q"))  # one row
    stats = values.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd")).where("n > 1 AND lo < hi").join(q)
    iqr = (F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 1.34
    spread = F.when((iqr > 0) & (iqr < F.col("sd")), iqr).otherwise(F.col("sd"))
    stats = stats.withColumn("h", F.lit(0.9) * spread * F.pow("n", F.lit(-0.2)))
    grid = stats.select("n", "h", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.struct(
        i.alias("i"), (F.col("lo") + (F.col("hi") - F.col("lo")) * i / (points - 1)).alias("at")))).alias("g")).select("n", "h", "g.i", "g.at")
    z = (F.col("at") - F.col("x")) / F.col("h")
    pairs = counts.join(F.broadcast(grid))  # the grid has ``points`` rows
    out = pairs.groupBy("i", "at", "n", "h").agg(F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("s"))
    return out.select("i", F.col("at").alias("x"), (F.col("s") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2) * F.pi()))).alias("density")).orderBy("i")


def box_plot(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """Per group: n, quartiles, whiskers (extreme values within 1.5 IQR), and outlier count."""
    key = S.text(df, group) if group else F.lit("")
    rows = df.select(key.alias("group"), S.finite(S.number(df, column)).alias("x")).where("x IS NOT NULL")
    stats = quantiles(rows, ["group"], "x", (0.25, 0.5, 0.75)).select(
        "group", "n", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("q3"))
    inside = F.col("x").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    out = rows.join(stats, "group").groupBy("group", "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"), F.max(F.when(inside, F.col("x"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    return out.orderBy(S.order_text(F.col("group")), "group")


def outliers(df: DataFrame, column: str, limit: int = OUTLIERS) -> DataFrame:
    """The first values outside the fences, ascending."""
    return group_outliers(df, column, None, limit).select("x").orderBy("x")


def group_outliers(df: DataFrame, column: str, group: str | None = None, limit: int = OUTLIERS) -> DataFrame:
    """group, place, x: each group's first values outside its fences, ascending."""
    key = S.text(df, group) if group else F.lit("")
    rows = df.select(key.alias("group"), S.finite(S.number(df, column)).alias("x")).where("x IS NOT NULL")
    q = quantiles(rows, ["group"], "x", (0.25, 0.75)).select("group", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    fence = 1.5 * (F.col("q3") - F.col("q1"))
    out = rows.join(q, "group").where((F.col("x") < F.col("q1") - fence) | (F.col("x") > F.col("q3") + fence))
    place = F.row_number().over(Window.partitionBy("group").orderBy("x"))
    return out.select("group", place.alias("place"), "x").where(F.col("place") <= limit)  # every task keeps a group's first values


def box_chart(df: DataFrame, column: str, group: str | None = None) -> dict:
    """Box plots, their outliers, and with two groups or more an analysis of variance."""
    from .stats import anova_test

    plots = box_plot(df, column, group)
    several = group is not None and plots.limit(2).count() == 2
    return {"plots": plots, "outliers": group_outliers(df, column, group), "anova": anova_test(df, group, column) if several else None}


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept, r2 (1 if y is constant); empty below two points or for constant x."""
    rows = df.select(S.finite(S.number(df, x)).alias("x"), S.finite(S.number(df, y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                   F.regr_r2("y", "x").alias("r2"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    return out.where("n >= 2 AND slope IS NOT NULL").select("n", "slope", "intercept", F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.col("r2")).alias("r2"))


def density_grid(df: DataFrame, x: str, y: str, columns: int = GRID[0], rows: int = GRID[1]) -> DataFrame:
    """column, row, count of the cells that hold points."""
    points = df.select(S.finite(S.number(df, x)).alias("x"), S.finite(S.number(df, y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def cell(v: str, lo: str, hi: str, n: int):
        span = F.when(F.col(hi) == F.col(lo), 1.0).otherwise(F.col(hi) - F.col(lo))
        return F.least(F.lit(n - 1), ((F.col(v) - F.col(lo)) / span * n).cast("int"))

    return points.join(F.broadcast(b)).groupBy(cell("x", "x0", "x1", columns).alias("column"), cell("y", "y0", "y1", rows).alias("row")).agg(  # b is one row
        F.count(F.lit(1)).alias("count"))


def points(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y: all finite pairs, however many."""
    return df.select(S.finite(S.number(df, x)).alias("x"), S.finite(S.number(df, y)).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")


def scatter(df: DataFrame, x: str, y: str, cap: int = SCATTER_POINTS) -> tuple[str, DataFrame]:
    """("points", all finite pairs) up to ``cap`` of them, else ("grid", density grid)."""
    found = points(df, x, y)
    return ("points", found) if found.limit(cap + 1).count() <= cap else ("grid", density_grid(df, x, y))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r: pairwise-complete Pearson in one pass; fewer than 3 pairs give null."""
    x = {c: S.finite(S.number(df, c)) for c in columns}
    aggs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            both = x[a].isNotNull() & x[b].isNotNull()
            n = F.count_if(both)
            r = F.when(n >= 2, 1.0) if a == b else F.when(n >= 3, F.coalesce(F.corr(F.when(both, x[a]), F.when(both, x[b])), F.lit(0.0)))
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), r.alias("r")).alias(f"p{len(aggs)}"))
    half = df.agg(*aggs).select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(aggs))])).alias("p")).select("p.*")
    return half.unionByName(half.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "r"))


def qq(df: DataFrame, column: str, cap: int = QQ_POINTS) -> DataFrame:
    """position, theoretical, sample: normal quantiles at Blom positions against sorted values."""
    values = _values(df, column)
    n = values.count()
    placed = sorting.positions(values.withColumn("tie", F.monotonically_increasing_id()), ["x", "tie"], "i").drop("tie")
    if n > cap:
        wanted = df.sparkSession.range(cap).select(F.floor(F.col("id") * (n - 1) / (cap - 1) + 0.5).cast("long").alias("i")).distinct()
        placed = placed.join(F.broadcast(wanted), "i")  # cap rows

    @F.pandas_udf("double")
    def quantile(p):
        from statistics import NormalDist

        return p.map(NormalDist().inv_cdf)

    return placed.select("i", quantile((F.col("i") + 1 - 0.375) / (F.lit(float(n)) + 0.25)).alias("theoretical"), F.col("x").alias("sample")).orderBy("i")


def histogram_chart(df: DataFrame, column: str, bins: int = 20) -> dict:
    """Histogram, density curve, and a normality test of a sample."""
    from .stats import shapiro_test

    return {"bins": aggregate.histogram(df, column, bins), "curve": kde(df, column), "normality": shapiro_test(df, column)}


def pivot_chart(long: DataFrame) -> tuple[str, DataFrame]:
    """("Line" | "Grouped" | "Bar", points) of a long pivot: a line if row keys read as dates."""
    keys = long.select("row_key").distinct()
    dated = keys.agg(F.bool_and(F.col("row_key").rlike(r"^\d{4}(-(\d{2}|W\d{2})(-\d{2})?)?$")).alias("d")).first()["d"]
    series = long.select("column_key").distinct().limit(2).count()
    return ("Line" if dated else "Grouped" if series > 1 else "Bar"), long.select(F.col("row_key").alias("category"), F.col("column_key").alias("series"), "value")
