"""Token-ID / binary output (8): Arrow stream files of fixed-size lists.

Each shard is one Arrow IPC stream: record batches of ``ids``
(fixed_size_list<uint16|uint32>[seq_len]) and ``mask`` (fixed_size_list<bool>), each but the last of
``BATCH_SEQS`` sequences.  Such batches are equally long in the file, so batch b starts at a
computed place and sequence k is row k % BATCH_SEQS of batch k // BATCH_SEQS: it is
read from a memory map without reading or copying others.  Beside it lies an index stream (doc_id, start, n_tokens within the shard).
Documents are range-partitioned by doc_id and their text's hash and sorted, so shard order is doc_id
order and rows that share one id are split, too; the ids of one shard are one run, padded only in its last sequence.
There are as many shards as the session's shuffle partitions, or more where a shard would hold over ``SHARD_CHARS`` characters.

A task writes to a name of its own and renames it when complete, so a retried
or speculative task leaves no half file.  The driver only sees one row per shard
(counts), from which shard offsets are summed.

Defined cases: a null text is empty and has the end id alone; a null doc_id sorts
first; rows that repeat a doc_id are each written, in order of their text's hash; very long texts are encoded whole;
an empty table gives no shards and an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, lean, shuffle_partitions
from .tokens import encoder, slices, tokenizer_path

SEQ_LEN = 2048
BATCH_SEQS = 512
SHARD_CHARS = 256_000_000
END_ID = 1


def _store(uri: str):
    """(filesystem, path) of a folder that executors share."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return store, path


class ShardWriter:
    """Writes ids, given piece by piece, as one Arrow stream of equal sequences."""

    def __init__(self, sink, dtype: np.dtype, seq_len: int):
        self.dtype, self.seq_len, self.total = np.dtype(dtype), seq_len, 0
        self.kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw)
        self.total += len(raw) // self.dtype.itemsize
        if self.size >= BATCH_SEQS * self.seq_len * self.dtype.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        raw = b"".join(self.held)
        row = self.seq_len * self.dtype.itemsize
        batch = BATCH_SEQS * row
        at = 0
        while len(raw) - at >= batch:
            self._write(raw[at: at + batch], BATCH_SEQS)
            at += batch
        if last and at < len(raw):
            self._write(raw[at:], -(-(len(raw) - at) // row))
            at = len(raw)
        self.held, self.size = [raw[at:]], len(raw) - at

    def _write(self, raw: bytes, whole: int) -> None:
        """One batch of so many sequences, the last one padded."""
        real = len(raw) // self.dtype.itemsize
        raw += b"\0" * (whole * self.seq_len * self.dtype.itemsize - len(raw))
        ids = pa.array(np.frombuffer(raw, self.dtype))
        mask = pa.array(np.arange(whole * self.seq_len) < real)
        self.out.write_batch(pa.record_batch(
            [pa.FixedSizeListArray.from_arrays(ids, self.seq_len),
             pa.FixedSizeListArray.from_arrays(mask, self.seq_len)], schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class Shard:
    """A shard read back: in one pass by ``batches``, or any sequence by ``sequence``."""

    def __init__(self, folder: str, name: str):
        store, path = _store(folder)
        local = f"{path}/{name}.arrow"
        self.source = pa.memory_map(local) if store.type_name == "local" else store.open_input_file(local)
        self.size = self.source.size()
        self.schema = pa.ipc.read_schema(self.source)
        self.seq_len = self.schema.field("ids").type.list_size
        self.first = self.source.tell()
        self.step = 0  # bytes of a whole batch; unknown before the first is read

    def _batch(self, b: int) -> pa.RecordBatch:
        """Batch b, from its computed place; its buffers are views of the file where that is mapped."""
        place = self.first + b * self.step
        if b and not self.step:
            self._batch(0)
            place = self.first + b * self.step
        if place >= self.size:
            raise IndexError(b)
        self.source.seek(place)
        try:
            message = pa.ipc.read_message(self.source)
        except EOFError:
            raise IndexError(b) from None
        if not b:
            self.step = self.source.tell() - place
        return pa.ipc.read_record_batch(message, self.schema)

    def batches(self):
        """Runs of the shard's ids as numpy arrays, without the padding."""
        b = 0
        while True:
            try:
                batch = self._batch(b)
            except IndexError:
                return
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            yield ids[: batch.column(1).flatten().true_count]
            b += 1

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, padding mask) of sequence k: views of the mapped file, where it is local."""
        if k < 0:
            raise IndexError(k)
        row = self._batch(k // BATCH_SEQS).slice(k % BATCH_SEQS, 1)
        if not len(row):
            raise IndexError(k)
        return row.column(0).flatten().to_numpy(zero_copy_only=True), row.column(1).flatten()


def write_shards(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID, seq_len: int = SEQ_LEN, dtype: str = "<u2") -> DataFrame:
    """Write all documents; returns (shard, name, n_docs, n_tokens), one row per shard.

    ``dtype`` must hold the vocabulary's ids: ``<u2`` below 65,536 ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = shuffle_partitions(spark, chars, SHARD_CHARS)
    rows = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    @lean
    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        name = f"shard-{shard:06d}"
        own = f"{name}.{task.taskAttemptId()}"
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        enc = encoder(path, dtype)
        end = np.array([end_id], dtype=dtype).tobytes()
        item = np.dtype(dtype).itemsize
        n_docs = 0
        index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        with store.open_output_stream(f"{base}/{own}.arrow") as sink, \
                store.open_output_stream(f"{base}/{own}.index") as index_sink:
            out = ShardWriter(sink, dtype, seq_len)
            index = pa.ipc.new_stream(index_sink, index_schema)
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                for a, b in slices(texts):
                    starts, lengths = [], []
                    for raw in enc.encode(texts[a:b]):
                        starts.append(out.total)
                        lengths.append(len(raw) // item + 1)
                        out.add(raw + end)
                    index.write_batch(pa.record_batch(
                        [ids.slice(a, b - a), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                        schema=index_schema))
                    n_docs += b - a
            out.close()
            index.close()
        for ending in ("arrow", "index"):
            store.move(f"{base}/{own}.{ending}", f"{base}/{name}.{ending}")
        if n_docs:
            yield pa.RecordBatch.from_pydict(
                {"shard": [shard], "name": [name], "n_docs": [n_docs], "n_tokens": [out.total]},
                schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return rows.mapInArrow(write, "shard int, name string, n_docs long, n_tokens long")


def read_shards(spark: SparkSession, manifest: list, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    ``manifest`` holds the rows of ``write_shards``, one per shard, so summing
    offsets on the driver is bounded by the number of files.
    """
    shards, start = [], 0
    for r in sorted(manifest, key=lambda r: r["shard"]):
        shards.append((r["name"], start))
        start += r["n_tokens"]
    todo = spark.createDataFrame(shards, "name string, base long").repartition(max(1, len(shards)))

    @lean
    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        store, path = _store(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                runs, held = Shard(folder, name).batches(), np.empty(0, "<u2")
                with store.open_input_file(f"{path}/{name}.index") as source:
                    for docs_batch in pa.ipc.open_stream(source):
                        lengths = docs_batch.column(2).to_numpy()
                        crcs = np.empty(len(lengths), np.int64)
                        for i, n in enumerate(lengths):
                            got = [held[:n]]
                            have = len(got[0])
                            held = held[have:]
                            while have < n:
                                held = next(runs)
                                got.append(held[: n - have])
                                held = held[len(got[-1]):]
                                have += len(got[-1])
                            crc = 0
                            for g in got:
                                crc = zlib.crc32(g.astype("<u4").tobytes(), crc)
                            crcs[i] = crc
                        yield pa.RecordBatch.from_arrays(
                            [docs_batch.column(0), pa.array(docs_batch.column(1).to_numpy() + base),
                             docs_batch.column(2), pa.array(crcs)], schema=schema)

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "binary")
    folder = ws.path("shards")
    manifest = write_shards(documents(spark, sf_dir), folder, tokenizer_path("word_bpe_49k.json")).collect()
    return read_shards(spark, manifest, folder)
