"""Quality classifier (9): Bradley-Terry pairwise ranking.

Method: each text becomes densities of byte classes and of pairs of neighbouring
classes, plus word statistics.  A linear score is learned from preference pairs (one
text labelled 1, one labelled 0) by logistic loss on the difference of their features.
The decision threshold is the score quantile at the share of label 0 in the sample;
``score`` is a logistic curve around it, so 0.5 is the threshold.

Learning takes about ``MAX_TRAIN_ROWS`` labelled rows (those of lowest hash) and
``PAIRS`` pairs; both are fixed bounds.  The model, a few hundred numbers, is broadcast.

Defined cases: a null text is empty; empty texts have all-zero densities and a score;
a doc_id labelled twice counts with its smaller label; labels that are null teach
nothing; without both labels every score is 0.5; a null doc_id is carried; repeated
rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean
from .shingles import text_blocks, word_hashes

MAX_TRAIN_ROWS = 10_000
PAIRS = 40_000
CLASSES = 14
_CLASS = np.full(256, 13, np.uint8)
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".", ",", "!?",
                             "|", "$%&#*", "+=<>/\\_~^@", "'\"()[]{};:-`")):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = 12
WIDTH = CLASSES + CLASSES * CLASSES + 5


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of WIDTH features per text."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    out = np.zeros((n, WIDTH))
    if len(data):
        kind = _CLASS[data].astype(np.int32)
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
        one = np.bincount(doc * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
        inside = doc[1:] == doc[:-1]
        cell = (doc[1:] * CLASSES + kind[:-1]) * CLASSES + kind[1:]
        two = np.bincount(cell[inside], minlength=n * CLASSES * CLASSES).reshape(n, -1)
        size = np.maximum(lengths, 1)[:, None]
        out[:, :CLASSES] = np.sqrt(one / size)
        out[:, CLASSES:CLASSES + CLASSES * CLASSES] = np.sqrt(two / size)
        words, bounds = word_hashes(data, offsets)
        owner = np.repeat(np.arange(n), np.diff(bounds))
        order = np.lexsort((words, owner))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][new], minlength=n)
        count = np.diff(bounds)
        some = np.maximum(count, 1)
        out[:, -5] = distinct / some
        out[:, -4] = np.log1p(count) / 10
        out[:, -3] = np.log1p(lengths / some)
        upper_first = np.bincount(owner, weights=(_CLASS[data[_starts(data, offsets)]] == 1) if len(words) else None, minlength=n)
        out[:, -2] = upper_first / some
    out[:, -1] = lengths == 0
    return out


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin, in the order of word_hashes."""
    blank = np.isin(data, np.array([0x20, *range(0x09, 0x0E)], np.uint8))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | edge[1:len(data)]
    return np.flatnonzero(starts)


class Ranker:
    """Linear scores over standardised features, and the decision threshold."""

    def __init__(self, mean=None, scale=None, weights=None, threshold: float = 0.0, spread: float = 1.0):
        self.mean, self.scale, self.weights = mean, scale, weights
        self.threshold, self.spread = threshold, spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.threshold) / self.spread, -30, 30)))


def learn(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, rounds: int = 300, seed: int = 11) -> Ranker:
    """Fit by gradient descent with momentum on -log sigmoid(w . (better - worse))."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker()
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = ((x - mean) / scale).astype(np.float32)
    better, worse = rng.choice(good, pairs), rng.choice(bad, pairs)
    w = np.zeros(x.shape[1], np.float32)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        s = z @ w
        pull = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        by_row = np.bincount(better, pull, len(z)) - np.bincount(worse, pull, len(z))
        grad = (by_row.astype(np.float32) @ z) / pairs - 1e-3 * w
        speed = 0.9 * speed + grad
        w = w + 0.1 * speed
    s = z @ w
    share = len(bad) / (len(bad) + len(good))
    low, high = np.quantile(s, [max(0.0, share - 0.002), min(1.0, share + 0.002)])
    spread = max(float(np.std(s)) / 4, 1e-6)
    return Ranker(mean, scale, w.astype(np.float64), float((low + high) / 2), spread)


def unseen(col: str = "doc_id") -> Column:
    """Rows whose labels learning never reads: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_train_rows: int = MAX_TRAIN_ROWS) -> Ranker:
    """Learn from about ``max_train_rows`` labelled documents outside the held-out fold."""
    known = (labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label"))
             .where("__id IS NOT NULL AND __label IN (0, 1)").where(~unseen("__id")))
    n = known.count()
    if n > max_train_rows:
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(9)), F.lit(1 << 30)) < int((1 << 30) * max_train_rows / n))
    known = F.broadcast(known.groupBy("__id").agg(F.min("__label").alias("__label")))  # about max_train_rows rows
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows = rows.join(known, "__id").select("__label", "__text")

    @lean
    def run(batches):
        schema = pa.schema([("label", pa.int32()), ("x", pa.binary())])
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1)):
                x = features(data, offsets).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(x)), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)

    got = rows.mapInArrow(run, "label int, x binary").collect()  # at most max_train_rows rows of WIDTH numbers
    got = sorted((r["label"], bytes(r["x"])) for r in got)
    if not got:
        return Ranker()
    return learn(np.stack([np.frombuffer(x, "<f4") for _, x in got]).astype(np.float64), np.array([y for y, _ in got]))


def score(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(ranker)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @lean
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for row, data, offsets in text_blocks(batch.column(1)):
                s = shared.value.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(s)), pa.array(s)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score(docs, fit(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", unseen().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
