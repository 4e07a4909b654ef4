"""Packing (7): hierarchical multi-length packing.

Method: whole windows of the longest tier are cut off each document; the rest is
routed to the shortest of the tiers (256, 512, 1024, 2048 tokens) that holds it.
Windows of the longest tier are opened by its documents, longest first; gaps are
filled with the largest pieces that fit from the shorter tiers, and a last gap by
cutting a piece there.  Then the next tier is packed in the same way.  Sequences
are grouped in steps of one tier and of equal token counts.

A task reads its documents once, in a stream, and holds one buffer of tails.  It ends
with fewer than 256 tokens in tails and, for each tier, the sequences of one step that isn't full.
These rests of ``GROUP`` tasks at a time are packed together in the same way: only they move.
A tier's last steps share its sequences evenly, and what is left of the tails, fewer
than 256 tokens a group, is closed in sequences whose lengths
are powers of two, so no padding is left.  ``sequence_id`` and ``step_id`` carry
the partition number in their high bits.

Defined cases: a null text is empty and consists of the end id; a null doc_id is
carried as null; rows that repeat a doc_id are packed each on their own; very long texts are
encoded whole and cut in windows; an empty
table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, documents, lean
from .tokens import CACHE_PIECES, encoder, slices, tokenizer_path

TIERS = (2048, 1024, 512, 256)
END_ID = 1
BUFFER_TOKENS = 1 << 20
STEP_TOKENS = 1 << 15
GROUP = 256
LATER = 1 << 30  # added to a group's number in its ids
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seq_len long, step_id long"
PIECE_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
STORED = PIECE + ", part long, raw binary"
STORED_SCHEMA = PIECE_SCHEMA.append(pa.field("part", pa.int64())).append(pa.field("raw", pa.binary()))


class Packer:
    """Packs the documents of one partition, or the rests of many; pieces come out as rows of PIECE.

    Rows of a step that isn't full and tails that fill no tier are ``left``.
    """

    def __init__(self, partition: int, tiers=TIERS, buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = STEP_TOKENS):
        self.base = partition << 32
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.buffer_tokens, self.step_tokens = buffer_tokens, step_tokens
        self.sequences = 0
        self.steps = 0
        self.open_steps: dict[int, list[list[tuple]]] = {}  # by length: the sequences of a step that isn't full
        self.tails: list[tuple[int, int, int | None, int, bytes, int]] = []
        self.tokens = self.serial = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """Take one document's ids (little-endian unsigned 32-bit, end id included)."""
        total, top, start = len(raw) // 4, self.tiers[0], 0
        while total - start >= top:
            self._sequence([(top, 0, doc_id, start, raw[start * 4:(start + top) * 4], total)], top)
            start += top
        if start < total:
            self.keep(total - start, doc_id, start, raw[start * 4:], total)
        if self.tokens >= self.buffer_tokens:
            self._pack(False)

    def left(self) -> tuple[list[tuple], list[tuple]]:
        """(rows of sequences without a step, rows of tails with their ids), once no document is to come."""
        self._pack(False)
        sequences = [row for open_step in self.open_steps.values() for parts in open_step for row in parts]
        tails = [(doc_id, start, length, None, total, None, None, None, None, raw) for length, _, doc_id, start, raw, total in self.tails]
        self.open_steps, self.tails = {}, []
        return sequences, tails

    def close(self) -> None:
        """Pack every tail, and share each length's remaining sequences evenly among its last steps."""
        self._pack(True)
        for size, open_step in self.open_steps.items():
            full = max(1, self.step_tokens // size)
            steps = -(-len(open_step) // full)
            for i, parts in enumerate(open_step):
                self._emit(parts, self.base + self.steps + i * steps // len(open_step))
            self.steps += steps
        self.open_steps = {}

    def keep(self, length, doc_id, start, raw, total) -> None:
        """Hold a tail that is shorter than the longest tier."""
        self.tokens += length
        self._hold(length, doc_id, start, raw, total)

    def _hold(self, length, doc_id, start, raw, total) -> None:
        self.serial += 1
        bisect.insort(self.tails, (length, self.serial, doc_id, start, raw, total), key=lambda t: t[:2])

    def _take(self, at_most: int):
        """The largest tail of at most so many tokens."""
        i = bisect.bisect_right(self.tails, at_most, key=lambda t: t[0])
        return self.tails.pop(i - 1) if i else None

    def _pack(self, last: bool) -> None:
        held = sum(t[0] for t in self.tails)
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0), strict=True):
            while self.tails and self.tails[-1][0] > shorter and held >= tier:
                self._window(tier)
                held -= tier
        while self.tails and held >= self.tiers[-1]:
            self._window(self.tiers[-1])
            held -= self.tiers[-1]
        while last and held:
            size = 1 << (held.bit_length() - 1)
            self._window(size)
            held -= size
        self.tokens = held

    def _window(self, size: int) -> None:
        """One sequence of exactly ``size`` tokens; at least so many are held."""
        parts, gap = [], size
        while gap:
            tail = self._take(gap)
            if tail is None:  # every tail is longer than the gap: cut the shortest
                length, _, doc_id, start, raw, total = self.tails.pop(0)
                self._hold(length - gap, doc_id, start + gap, raw[gap * 4:], total)
                tail = (gap, 0, doc_id, start, raw[: gap * 4], total)
            parts.append(tail)
            gap -= tail[0]
        self._sequence(parts, size)

    def _sequence(self, parts, size: int) -> None:
        offset, rows = 0, []
        for length, _, doc_id, start, raw, total in parts:
            rows.append((doc_id, start, length, zlib.crc32(raw), total, self.base + self.sequences, offset, size, None))
            offset += length
        self.sequences += 1
        self.take(rows, size)

    def take(self, rows: list[tuple], size: int) -> None:
        """A sequence's rows; with it its step may be full."""
        open_step = self.open_steps.setdefault(size, [])
        open_step.append(rows)
        if len(open_step) * size >= self.step_tokens and size >= self.tiers[-1]:
            for parts in open_step:
                self._emit(parts, self.base + self.steps)
            self.steps += 1
            del self.open_steps[size]

    def _emit(self, rows: list[tuple], step: int) -> None:
        self.rows += [(*row[:8], step) for row in rows]

    def drain(self):
        """The pieces that are ready."""
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple], part: int, ids: bool = False) -> pa.RecordBatch:
    """Rows of PIECE, or with ``ids`` of PIECE and raw, as a batch of STORED."""
    if not ids:
        rows = [(*r, None) for r in rows]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(len(PIECE_SCHEMA) + 1)]
    arrays = [pa.array(c, pa.int64()) for c in columns[:-1]]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int64()), pa.array(columns[-1], pa.binary())], schema=STORED_SCHEMA)


def pack_rests(group: int, table: pa.Table, tiers, step_tokens: int) -> pa.Table:
    """Pieces of the rests (rows of STORED) of one group of tasks."""
    packer = Packer(LATER + group, tiers, 1 << 62, step_tokens)
    rows = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending"), ("length", "descending"),
                          ("doc_id", "ascending"), ("start", "ascending"), ("raw", "ascending")]).to_pylist()
    names, held = PIECE_SCHEMA.names, []
    for i, r in enumerate(rows):
        if r["raw"] is not None:
            packer.keep(r["length"], r["doc_id"], r["start"], r["raw"], r["doc_tokens"])
            continue
        held.append(tuple(r[n] for n in names))
        if i + 1 == len(rows) or rows[i + 1]["sequence_id"] != r["sequence_id"]:
            packer.take(held, r["seq_len"])
            held = []
    packer.close()
    done = packer.drain()
    return pa.table([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], schema=PIECE_SCHEMA) if done else PIECE_SCHEMA.empty_table()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID, tiers=TIERS, step_tokens: int = STEP_TOKENS, keep: int = CACHE_PIECES) -> DataFrame:
    """Pieces of all documents: PIECE's columns, one row per piece.

    ``keep`` bounds the table of tokenized pieces that a worker holds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @lean
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packer = Packer(part, tiers, step_tokens=step_tokens)
        enc = encoder(path, "<u4", keep)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc_id, raw in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    packer.add(doc_id, raw + end)
                if packer.rows:
                    yield _batch(packer.drain(), part)
        sequences, tails = packer.left()
        yield _batch(packer.drain() + sequences, part)
        yield _batch(tails, part, True)

    def rests(key, table):
        return pack_rests(key[0].as_py(), table.drop_columns(["group"]), tiers, step_tokens)

    ws = Workspace(docs.sparkSession, "packing")
    stored = ws.save(rows.mapInArrow(run, STORED), "stored")
    names = PIECE_SCHEMA.names
    late = stored.where("step_id IS NULL").withColumn("group", F.floor(F.col("part") / GROUP))  # a few hundred rows a task
    return stored.where("step_id IS NOT NULL").select(*names).unionByName(late.groupBy("group").applyInArrow(rests, PIECE))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
