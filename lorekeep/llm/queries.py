"""The operators' queries, and SQL where it can express them."""

from __future__ import annotations

from . import op1_multi_index, op2_ngram_join, op3_training_order, op4_sentencepiece, op5_toxicity, op6_token_counts, op7_pii, op8_packing, op9_exact_dedup, op10_language

QUERIES = {
    "op1_inverted_multi_index": op1_multi_index.query,
    "op2_ngram_jaccard_join": op2_ngram_join.query,
    "op3_training_order": op3_training_order.query,
    "op4_sentencepiece": op4_sentencepiece.query,
    "op5_toxicity": op5_toxicity.query,
    "op6_token_counts": op6_token_counts.query,
    "op7_pii": op7_pii.query,
    "op8_best_fit_packing": op8_packing.query,
    "op9_exact_dedup": op9_exact_dedup.query,
    "op10_language_id": op10_language.query,
}

ORACLE: dict[str, str] = {
    "op2_ngram_jaccard_join": op2_ngram_join.ORACLE,
    "op9_exact_dedup": op9_exact_dedup.ORACLE,
}
