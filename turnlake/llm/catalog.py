"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from turnlake.llm import (
    bpe_encode,
    exact_dedup,
    hash_search,
    language_id,
    mixed_packing,
    mixing,
    ngram_join,
    quality,
    secrets,
    source_audit,
    token_counts,
    toxicity,
    vector_codes,
)

QUERIES = {
    "op1_importance_resampling": quality.op1_importance_resampling,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_ngram_jaccard_join": ngram_join.op3_ngram_jaccard_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op10_byte_bpe": bpe_encode.op10_byte_bpe,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_hash_search": hash_search.op9_hash_search,
    "op11_source_divergence": source_audit.op11_source_divergence,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_mixed_packing": mixed_packing.op13_mixed_packing,
}

ORACLES = {
    "op3_ngram_jaccard_join": ngram_join.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_source_divergence": source_audit.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}
