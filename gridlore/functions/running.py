"""Running sums, positions and exact quantiles over range partitions: no task gets all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: monotonically_increasing_id keeps the row's place in its partition in these low bits.
PLACE_BITS = 33


def scratch(spark: SparkSession) -> str:
    """A new path in the folder in ``spark.checkpoint.dir``, deleted when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_DIR:
            _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="gridlore-"))
        folder = _OWN_DIR[0]
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/gridlore/scratch-{uuid.uuid4().hex}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(base)
    fs.deleteOnExit(base)
    return f"{base.toString()}/table"


def store(df: DataFrame) -> DataFrame:
    """``df`` written to a scratch path and read back."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, order: list, name: str) -> DataFrame:
    """0-based positions in a total order.

    Rows are range-partitioned and sorted once and stored with their places; the sizes
    of the partitions, one number each, give each its first position.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = store(ranged.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", PLACE_BITS).cast("int")
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per partition
    first, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        first.append(total)
        total += sizes.get(p, 0)
    starts = F.split(F.lit(",".join(map(str, first)) or "0"), ",").cast("array<long>")
    place = F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1)
    return placed.withColumn(name, F.get(starts, part) + place).drop("__place")


def cumulate(df: DataFrame, keys: list[str], order: list, weight: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``weight`` over the rows of the same keys that come earlier in the order.

    Rows are range-partitioned by keys and order, so a hot group is split over tasks; a
    task sums its own rows, and the sums that earlier tasks hold of its first group, one
    row a task, are added afterwards.  Keys must not be null; weights are longs.
    """
    spark, columns = df.sparkSession, df.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    key_at, weight_at = [columns.index(k) for k in keys], columns.index(weight)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, last, total, head = TaskContext.get().partitionId(), None, 0, True
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            new = np.zeros(size, bool)
            for i in key_at:
                new[1:] |= pc.not_equal(batch.column(i).slice(1), batch.column(i).slice(0, size - 1)).to_numpy(zero_copy_only=False)
            here = tuple(batch.column(i)[0].as_py() for i in key_at)
            if here != last:
                new[0], total, head = True, 0, head and last is None
            w = batch.column(weight_at).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(w)
            start = np.maximum.accumulate(np.where(new, np.arange(size), -1))
            before = upto - w - np.where(start > 0, upto[start - 1], 0) + np.where(start < 0, total, 0)
            firsts = np.flatnonzero(new[1:]) + 1
            heads = np.zeros(size, bool)
            if head:
                heads[: firsts[0] if len(firsts) else size] = True
                head = not len(firsts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(size, part, np.int32)), pa.array(heads)],
                                             names=[*columns, "before", "__part", "__head"])
            last, total = tuple(batch.column(i)[size - 1].as_py() for i in key_at), int(before[-1] + w[-1])

    ranged = df.repartitionByRange(partitions(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    stored = store(ranged.select(*columns).mapInArrow(run, f"{kinds}, before long, __part int, __head boolean"))
    after = F.max(F.col("before") + F.col(weight))
    if not keys:
        held = stored.groupBy("__part").agg(after.alias("s"))
        base = held.select("__part", F.sum("s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__base"))
    else:
        crossing = F.broadcast(stored.where("__head").select(*keys).distinct())  # a row per task at most
        held = stored.join(crossing, keys, "left_semi").groupBy(*keys, "__part").agg(after.alias("s"))
        earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        base = held.select(*keys, "__part", F.sum("s").over(earlier).alias("__base"))
    out = stored.join(F.broadcast(base), [*keys, "__part"], "left")  # a row or two per task
    return out.select(*columns, (F.col("before") + F.coalesce("__base", F.lit(0))).alias("before"))


def quantiles(values: DataFrame, keys: list[str], x: str, shares: tuple[float, ...]) -> DataFrame:
    """keys, n, q: exact interpolated quantiles of ``x`` within each group of ``values``; nulls of x are left out.

    Equal values are counted first, so a value that very many rows share costs one row.
    """
    counts = values.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    placed = cumulate(counts, keys, ["__x"], "__c")
    sizes = placed.groupBy(*keys).agg(F.sum("__c").alias("n"))
    both = placed.join(sizes, keys) if keys else placed.join(F.broadcast(sizes))  # without keys one row
    low = [F.floor((F.col("n") - 1) * F.lit(p)) for p in shares]
    high = [F.ceil((F.col("n") - 1) * F.lit(p)) for p in shares]

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("__c")), F.col("__x")))

    ends = both.groupBy(*keys, "n").agg(*[at(r).alias(f"l{i}") for i, r in enumerate(low)], *[at(r).alias(f"h{i}") for i, r in enumerate(high)])
    parts = []
    for i, p in enumerate(shares):
        rank = (F.col("n") - 1) * F.lit(p)
        parts.append(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (rank - F.floor(rank)))
    return ends.select(*keys, "n", F.array(*parts).alias("q"))
