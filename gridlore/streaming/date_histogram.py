"""Date histogram over a stream: counts and sums per day with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(stream: DataFrame, time_col: str, value_col: str | None = None, late: str = "1 day") -> DataFrame:
    """label, count and with a value column sum and average, per day of event time."""
    rows = stream.withColumn("__t", F.col(time_col).cast("timestamp")).withWatermark("__t", late)
    aggs = [F.count(F.lit(1)).alias("count")]
    if value_col:
        v = F.coalesce(F.col(value_col).cast("double"), F.lit(0.0))
        aggs += [F.sum(v).alias("sum"), (F.sum(v) / F.count(F.lit(1))).alias("average")]
    out = rows.groupBy(F.window("__t", "1 day")).agg(*aggs)
    return out.withColumn("label", F.date_format("window.start", "yyyy-MM-dd")).drop("window")
