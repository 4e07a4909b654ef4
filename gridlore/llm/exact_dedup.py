"""Exact dedup (6): a persistent digest index, bucketed and sorted by hash.

Method: texts are normalised by deleting the characters of ``[\\x20\\x09-\\x0D]``
and digested with SHA-256.  The index is a table bucketed and sorted by digest.
A batch is first reduced to one row per digest (map-side combine, so a digest
that a third of all rows share costs one row per task), then anti-joined to the
index by sort-merge join on the bucketing key, and the new digests are appended.
What stays is then read from the index by a join on the same key; rows get their
digest's decision by a plain join, which adaptive execution splits at a hot digest.

Retries: every row of the index names its batch.  What a batch itself has appended
never counts against it, and a digest is appended once, so a batch that is processed
again, after a failure or for lost results, gets the same answer.  Without a name a
batch is named by its contents: the same rows again are a retry.  Give names where the
same rows may be delivered twice.  One batch is processed at a time.

Defined cases: a null text counts as empty; empty texts are equal to each other;
very long texts are digested whole; a null doc_id is an ordinary row and loses ties to any id; rows repeated with one
doc_id all count in ``group_size`` and share one decision; an empty table gives
an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, numbered, without

BLANKS = r"[\x20\x09-\x0D]"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *further: str) -> DataFrame:
    """(doc_id, digest, n_code_points, further columns) of every row; digest is the binary SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256)).alias("digest"),
        F.length(text).alias("n_code_points"),
        *further,
    )


class DigestIndex:
    """Digests seen so far, in a table bucketed and sorted by digest.

    With a name the table stays in the catalog's warehouse; without one it lies in a
    workspace and goes with the application.
    """

    COLUMNS = "digest binary, keep_id long, n_code_points int, batch string"

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"gridlore_digests_{uuid.uuid4().hex}"
        self.path = None if name else Workspace(spark, "digests").path("index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], self.COLUMNS))

    def _write(self, rows: DataFrame) -> None:
        writer = rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet")
        (writer.option("path", self.path) if self.path else writer).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        """Add (digest, keep_id, n_code_points, batch) rows of digests that the index doesn't hold."""
        fresh = rows.hint("merge").join(self.read().hint("merge"), "digest", "left_anti")
        # Spark doesn't overwrite or append what it reads in the same job: the new digests are stored first
        ws = Workspace(self.spark, "fresh")
        self._write(ws.save(fresh.select("digest", "keep_id", "n_code_points", "batch"), "fresh").repartition(self.buckets, "digest"))
        ws.drop("fresh")

    def dedup(self, batch: DataFrame, ws: Workspace, name: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
        """Decide on a batch of (doc_id, digest, n_code_points, order columns) and append its new digests.

        Returns doc_id, digest, keep_id, group_size, kept, seen_before.  Of equal
        rows the one with the most code points stays, then the first by ``order``, then the smallest doc_id; a
        digest that the index holds from another batch keeps the row recorded there, and no
        row of this batch stays.
        """
        batch = ws.save(batch, "batch")
        best = F.min(F.struct((-F.col("n_code_points")).alias("few"), *order, F.col("doc_id").isNull().alias("no_id"), "doc_id"))
        groups = batch.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        groups = ws.save(groups.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.few")).alias("n_code_points"), "group_size"), "groups")
        name = name or _fingerprint(groups)
        self.append(groups.withColumn("batch", F.lit(name)))
        known = self.read().select("digest", F.col("keep_id").alias("first_id"), F.col("batch").alias("first_batch"))
        decided = groups.select("digest", "group_size").hint("merge").join(known.hint("merge"), "digest")
        decided = ws.save(decided.select("digest", F.col("first_id").alias("keep_id"), "group_size", (F.col("first_batch") != name).alias("seen_before")), "decided")
        ws.drop("groups")
        out = batch.join(decided, "digest")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("seen_before")
        return out.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"), "seen_before")


def _fingerprint(groups: DataFrame) -> str:
    """A batch's name by its contents, whatever their order."""
    h = F.xxhash64("digest", "keep_id", "n_code_points", "group_size")
    r = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.bit_xor(F.xxhash64(h, F.lit(6))), F.lit(0)).alias("y")).first()
    return f"{r['n']}-{r['x'] & (1 << 64) - 1:016x}{r['y'] & (1 << 64) - 1:016x}"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, seen_before."""
    spark = docs.sparkSession
    ws = Workspace(spark, "exact")
    index = index or DigestIndex(spark)
    out = index.dedup(digests(docs, id_col, text_col), ws, batch)
    return out.select("doc_id", "keep_id", "group_size", "kept",
                      F.lower(F.hex("digest")).alias("text_sha256"), "seen_before")


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of ``docs`` per digest, whatever the ids: most code points, then smallest id, null last."""
    ws = Workspace(docs.sparkSession, "unique")
    rows = numbered(ws, docs)
    given = F.col(id_col).cast("long")
    keys = digests(rows.select("__row", F.struct(given.isNull().alias("none"), given.alias("id")).alias("__given"), F.col(text_col).alias("__text")),
                   "__row", "__text", "__given")
    out = DigestIndex(docs.sparkSession).dedup(keys, ws, order=("__given",)).where("NOT kept").select("doc_id")
    return without(rows, out, "__row").drop("__row")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS n_cp
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_cp DESC, doc_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
