"""What the corpus operators share: shared-folder tables, connected components, hashing.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every
executor can read, so a lost executor never loses them.  Where the setting is
absent on a local master (tests, a laptop) a folder of our own is used instead; on a
cluster that is an error, as executors don't see each other's disks.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
#: Up to so many rows of ids (8 bytes, or 8 and a key of 16) are broadcast, 16 MB at most; more are joined by shuffle.
BROADCAST_IDS = 250_000
#: Low bits of a row's number that hold its place in its file.
PLACE_BITS = 40
#: Rows of a file of two or three numbers a row.
ROWS_A_FILE = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="gridlore-"))
    return _OWN_DIR[0]


def release() -> None:
    """Give memory that this process has freed, but its allocators hold, back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run):
    """``run`` (batches to batches), whose worker releases its free memory when the task ends.

    Workers serve one stage after another; without this each keeps the peak of every stage it has run.
    """
    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


class Workspace:
    """Parquet tables under the shared folder, to cut lineage durably.

    ``save`` writes a DataFrame and returns it as read back; ``drop`` deletes a
    table that nothing will read again.  The folder is deleted when the application ends,
    as results read from it until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/gridlore/{label}-{uuid.uuid4().hex}"
        folder, fs = self._file(self.base)
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)

    def _file(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Store and read back; ``files`` bounds the files of a table known to be small."""
        path = self.path(name)
        (df if files is None else df.coalesce(files)).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            target, fs = self._file(self.path(name))
            fs.delete(target, True)


def shuffle_partitions(spark: SparkSession, rows: int = 0, rows_each: int = 1_000_000) -> int:
    """The session's shuffle partitions, or more where ``rows`` asks for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_each))


def connected_components(ws: Workspace, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b); component = smallest id.

    Each round every vertex points at its smallest neighbour if that is smaller than
    itself, pointers are followed to their ends by doubling, and edges are rewritten
    between the ends.  A vertex only ever points at a smaller id, so the last end is
    the component's minimum.  No vertex gathers its neighbour list: the one grouping is
    a ``min`` with map-side combine, and joins run between two stored tables, which
    lets adaptive execution split a hot vertex.  Loops and repeated edges are fine;
    empty edges give an empty result.
    """
    steps: list[DataFrame] = []
    first = 1
    current = ws.save(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
                      .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), f"{label}-e0")
    k = 0
    while n := current.count():
        files = 1 + n // ROWS_A_FILE
        first = max(first, files)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n"))
        point = ws.save(point.select("id", F.least("id", "n").alias("to"), (F.col("id") < F.col("n")).alias("end")), f"{label}-p{k}-0", files)
        hops = 0
        while True:
            hop = point.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("end").alias("end2"))
            point = ws.save(point.join(hop, "to").select("id", F.col("to2").alias("to"), "end", "end2"), f"{label}-p{k}-{hops + 1}", files)
            ws.drop(f"{label}-p{k}-{hops}")
            hops += 1
            if point.where("NOT end2").isEmpty():
                break
            point = point.drop("end2")
        point = point.select("id", "to")
        steps.append(point)
        left = point.select(F.col("id").alias("a"), F.col("to").alias("ta"))
        right = point.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = (current.join(left, "a").join(right, "b")
                 .where("ta <> tb")
                 .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        k += 1
        nxt = ws.save(moved, f"{label}-e{k}", files)
        ws.drop(f"{label}-e{k - 1}")
        current = nxt
    if not steps:
        return current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    result = steps[0].select("id", F.col("to").alias("component"))
    for i, step in enumerate(steps[1:], 1):
        nxt = step.select(F.col("id").alias("component"), F.col("to").alias("root"))
        result = ws.save(result.join(nxt, "component", "left")
                         .select("id", F.coalesce("root", "component").alias("component")), f"{label}-r{i}", first)
    return result


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A whole table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _one_parquet_scan(docs: DataFrame) -> bool:
    """Whether ``docs`` is columns and rows of one scan of Parquet files, each row at most once."""
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        if node.children().size() != 1:
            return False
        node = node.children().head()
    return node.getClass().getSimpleName() == "LogicalRelation" and node.toString().rstrip().endswith("parquet")


def numbered(ws: Workspace, docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row (``__row``), to decide by row where ids are null or repeated.

    Rows of Parquet files are numbered by file and place in the file, which every scan
    gives alike however its splits are dealt; rows from elsewhere are stored with their numbers.
    """
    if not _one_parquet_scan(docs):
        return ws.save(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    files = sorted(r[0] for r in placed.select("__file").distinct().collect())  # a row per file
    number = F.broadcast(docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), "__file string, __number long"))
    return placed.join(number, "__file").select(*docs.columns, (F.shiftleft("__number", PLACE_BITS) + F.col("__place")).alias("__row"))


def carried(ws: Workspace, rows: DataFrame, key: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` stored with ``__n``, their number from 1 within a key in an order, and ``__before``, the last ``value`` before
    each row that isn't null.  Keys must not be null; ``value`` is a long.

    Rows are range-partitioned by key and order, so a hot key is split over tasks.  A task
    numbers its own rows; what the earlier tasks hold of its first key, a row per task, is
    added afterwards.
    """
    columns = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at, value_at = [columns.index(k) for k in key], columns.index(value)

    @lean
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, last_key, n, last, first_group = TaskContext.get().partitionId(), None, 0, None, True
        for batch in batches:
            size = len(batch)
            if not size:
                continue
            new = np.zeros(size, bool)
            for i in at:
                new[1:] |= pc.not_equal(batch.column(i).slice(1), batch.column(i).slice(0, size - 1)).to_numpy(zero_copy_only=False)
            here = tuple(batch.column(i)[0].as_py() for i in at)
            if here != last_key:
                new[0], n, last = True, 0, None
                first_group &= last_key is None
            place = np.arange(size)
            start = np.maximum.accumulate(np.where(new, place, -1))
            numbers = np.where(start >= 0, place - start + 1, place + 1 + n)
            values = batch.column(value_at)
            known = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), place, -1))
            known = np.append(-1, known[:-1])  # before this row
            own = known >= np.maximum(start, 0)
            plain = values.fill_null(0).to_numpy(zero_copy_only=False)
            before = np.where(own, plain[known], 0 if last is None else last)
            missing = ~own & ((start >= 0) | (last is None))
            head = np.zeros(size, bool)
            if first_group:
                head[: (np.flatnonzero(new[1:])[0] + 1) if new[1:].any() else size] = True
                first_group = not new[1:].any()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers), pa.array(before.astype(np.int64), mask=missing),
                                              pa.array(np.full(size, part, np.int32)), pa.array(head)], names=[*columns, "__n", "__before", "__part", "__head"])
            last_key, n = tuple(batch.column(i)[size - 1].as_py() for i in at), int(numbers[-1])
            end = values[size - 1].as_py()
            last = end if end is not None else None if missing[-1] else int(before[-1])

    parts = shuffle_partitions(ws.spark)
    ranged = rows.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    stored = ws.save(ranged.mapInArrow(run, f"{kinds}, __n long, __before long, __part int, __head boolean"), name)
    crossing = F.broadcast(stored.where("__head").select(*key).distinct())  # a row per task at most
    held = stored.join(crossing, key, "left_semi").groupBy(*key, "__part").agg(
        F.max("__n").alias("c"), F.max_by(F.coalesce(value, "__before"), "__n").alias("v"))
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task and crossing key
    base = held.select(*key, "__part", F.sum("c").over(earlier).alias("__c"), F.last("v", True).over(earlier).alias("__v")).where("__c IS NOT NULL")
    out = stored.join(F.broadcast(base), [*key, "__part"], "left")
    return out.select(*columns, (F.col("__n") + F.coalesce("__c", F.lit(0))).alias("__n"), F.coalesce("__before", "__v").alias("__before"))


def without(docs: DataFrame, out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``out`` (doc_id); null ids stay.

    The ids are counted first: few enough are broadcast, so texts don't move.
    """
    ws = Workspace(docs.sparkSession, "without")
    out = ws.save(out.select(F.col("doc_id").alias("__out_id")).distinct(), "ids")
    wanted = F.broadcast(out) if out.count() <= BROADCAST_IDS else out
    return docs.join(wanted, docs[id_col] == wanted["__out_id"], "left_anti")
