"""Language ID (3): multinomial naive Bayes over hashed character n-grams.

Learning counts hashed 2- and 3-grams of lower-cased letters, word edges included,
per language, over a sample of labelled rows of about ``max_train_rows`` (the
rows of lowest hash, the same on every run).  The counts come back as dense blocks,
one per language and sample task, so their size is ``languages * buckets``.  The
log-probability matrix (buckets x languages, 32-bit) is broadcast; its size does
not depend on the corpus.  Scoring goes over each whole text in blocks of about a
million characters.

Defined cases: a null text or one without a letter is ``und`` with score 0; rows
with a null language are not learned from; with nothing to learn from every row
is ``und``; ties go to the language first in alphabetical order; a null doc_id is
carried as null; repeated rows are scored each; an empty table gives an empty
result; the language column is only read for learning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean
from .tokens import slices

BUCKETS = 1 << 15
MAX_TRAIN_ROWS = 20_000
SAMPLE_TASKS = 8
SMOOTHING = 0.1
UNDETERMINED = "und"
MIN_SCORE = 0.4

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram, and the number of letters of each text."""
    lowered = [t.lower() for t in texts]
    joined = " " + " ".join(lowered) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) for t in lowered), np.int64, len(lowered))
    is_letter = _letters()[codes]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1)
    doc = np.concatenate([doc[:1], doc]) if len(texts) else np.zeros(len(codes), np.int32)
    n_letters = np.bincount(doc[is_letter], minlength=len(texts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    symbols = np.where(is_letter, codes, np.uint32(32))[keep]
    doc = doc[keep]
    if len(symbols) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int32), n_letters
    a, b, c = symbols[:-2], symbols[1:-1], symbols[2:]
    inner = b != 32
    doc = doc[1:-1][inner]
    a, b, c = a[inner], b[inner], c[inner]
    mask = np.uint32(buckets - 1)
    two = b * np.uint32(0x85EBCA77) ^ c * np.uint32(0xC2B2AE3D)
    three = two ^ a * np.uint32(0x9E3779B1)
    two ^= two >> np.uint32(15)
    three ^= three >> np.uint32(13)
    two *= np.uint32(0x27D4EB2F)
    three *= np.uint32(0x165667B1)
    two ^= two >> np.uint32(16)
    three ^= three >> np.uint32(16)
    return np.concatenate([doc, doc]), np.concatenate([two & mask, three & mask]).astype(np.int32), n_letters


class Model:
    """Languages in order and their log-probabilities by bucket."""

    def __init__(self, languages: list[str], log_prob: np.ndarray, log_prior: np.ndarray):
        self.languages, self.log_prob, self.log_prior = languages, log_prob, log_prior

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        doc, bucket, n_letters = grams(texts, len(self.log_prob[0]))
        total = np.stack([np.bincount(doc, weights=row[bucket], minlength=len(texts)) for row in self.log_prob], 1)
        total += self.log_prior
        best = total.argmax(1)
        total -= total.max(1, keepdims=True)
        sure = 1 / np.exp(total).sum(1)
        sure[n_letters == 0] = 0
        names = [self.languages[i] if n else UNDETERMINED for i, n in zip(best, n_letters, strict=True)]
        return names, sure


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
        max_train_rows: int = MAX_TRAIN_ROWS, buckets: int = BUCKETS) -> Model:
    """Learn from about ``max_train_rows`` of the rows with a language."""
    rows = labelled.where(F.col(lang_col).isNotNull())
    n = rows.select(lang_col).count()
    if n > max_train_rows:
        place = F.pmod(F.xxhash64(F.col(key_col).cast("string"), F.lit(3)), F.lit(1 << 30))
        rows = rows.where(place < int((1 << 30) * max_train_rows / n))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartition(SAMPLE_TASKS)

    @lean
    def count(batches):
        tables: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts, 500_000):
                doc, bucket, _ = grams(texts[lo:hi], buckets)
                names = sorted(set(langs[lo:hi]))
                number = np.array([names.index(x) for x in langs[lo:hi]])
                cells = np.bincount(number[doc].astype(np.int64) * buckets + bucket, minlength=len(names) * buckets)
                for i, name in enumerate(names):
                    part = cells[i * buckets:(i + 1) * buckets]
                    tables[name] = tables[name] + part if name in tables else part
                    seen[name] = seen.get(name, 0) + int((number == i).sum())
        names = sorted(tables)
        yield pa.RecordBatch.from_pydict(
            {"lang": names, "n": [seen[x] for x in names], "counts": [tables[x].astype("<i8").tobytes() for x in names]},
            schema=pa.schema([("lang", pa.string()), ("n", pa.int64()), ("counts", pa.binary())]))

    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for r in rows.mapInArrow(count, "lang string, n long, counts binary").toLocalIterator():
        block = np.frombuffer(bytes(r["counts"]), "<i8")
        counts[r["lang"]] = counts[r["lang"]] + block if r["lang"] in counts else block
        docs[r["lang"]] = docs.get(r["lang"], 0) + r["n"]
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, buckets), np.float32), np.zeros(0))
    table = np.stack([counts[x] for x in languages]).astype(np.float64) + SMOOTHING
    log_prob = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
    prior = np.array([docs[x] + 1.0 for x in languages])
    return Model(languages, log_prob, np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @lean
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in slices(texts, 500_000):
                names, sure = shared.value.score(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(sure)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(col: str = "doc_id") -> Column:
    """Rows that learning never sees: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is known: not ``und``, and score at least ``min_score``."""
    model = fit(docs.where(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(texts):
        import pandas as pd

        out = []
        plain = ["" if t is None else t for t in texts]
        for lo, hi in slices(plain, 500_000):
            names, sure = shared.value.score(plain[lo:hi])
            out += [n != UNDETERMINED and s >= min_score for n, s in zip(names, sure, strict=True)]
        return pd.Series(out, dtype=bool)

    return docs.where(known(F.col("text")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()))
    out = predict(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
