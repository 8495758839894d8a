"""Queries on the corpus tables, and SQL twins where SQL can express them."""

from __future__ import annotations

from tallyrank.llm import (corpus_sql, decontaminate, language_codes, lm_score, near_join, outliers, packing, prefix_trie,
                           quality_model, records, repeated_passages, sharding, spelling, toxicity)

QUERIES = {
    "op1_robust_outliers": outliers.op1,
    "op2_residual_packing": packing.op2,
    "op3_binary_records": records.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_repeated_passages": repeated_passages.op5,
    "op6_kd_sharding": sharding.op6,
    "op7_quality_network": quality_model.op7,
    "op8_subword_toxicity": toxicity.op8,
    "op9_backoff_automaton": lm_score.op9,
    "op10_jaccard_forest": near_join.op10,
    "op11_language_codes": language_codes.op11,
    "op12_spelling_variants": spelling.op12,
    "op13_prefix_trie": prefix_trie.op13,
}

ORACLES: dict[str, str] = {
    "op12_spelling_variants": corpus_sql.OP12,
    "op13_prefix_trie": corpus_sql.OP13,
}
