"""From raw documents to packed sequences: five stages, each stored before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridlore.llm import exact_dedup, jaccard_join, langid, mixing, packing
from gridlore.llm.common import Workspace, documents
from gridlore.llm.tokens import tokenizer_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identified language."""
    return langid.keep_identified(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents, one row stays."""
    return exact_dedup.unique_rows(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8), one row stays."""
    return jaccard_join.one_row_of_each(docs, width=5, threshold=80)


def reach_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep and repeat documents by the rates that mix their domains to the target weights."""
    return mixing.resample(docs, mixing.label_domains(documents(spark, sf_dir, "labels")), mixing.TARGETS, weights=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed; workers that have run four stages hold a small table of pieces."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), keep=150_000)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_exact),
    ("ngram_jaccard_join", drop_near),
    ("mixing", reach_targets),
    ("packing", pack_sequences),
]
#: Learned models and a tokenizer's vocabulary have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
