"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import binary_output, embedding_dedup, exact_dedup, jaccard_join, langid, mixing, packing, pii, quality, quotes

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1,
    "op2_pii": pii.op2,
    "op3_language_id": langid.op3,
    "op4_mixing": mixing.op4,
    "op5_quotation_linking": quotes.op5,
    "op6_exact_dedup": exact_dedup.op6,
    "op7_packing": packing.op7,
    "op8_binary_output": binary_output.op8,
    "op9_quality": quality.op9,
    "op10_embedding_dedup": embedding_dedup.op10,
}
ORACLE = {"op6_exact_dedup": exact_dedup.ORACLE}
