"""The operators' queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from proofbase.llm import backoff, chat, decontaminate, divergence, jaccard, lines, mixing, packing, quality, sharding, substrings, whitening
from proofbase.llm.toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_suffix_array_dedup": substrings.op3_suffix_array_dedup,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_ngram_jaccard": jaccard.op8_ngram_jaccard,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_lm_scoring": backoff.op10_lm_scoring,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_curve_packing": packing.op13_curve_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": decontaminate.ORACLE,
    "op3_suffix_array_dedup": substrings.ORACLE,
    "op8_ngram_jaccard": jaccard.ORACLE,
    "op9_quality_rules": quality.ORACLE,
    "op5_line_dedup": lines.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op10_lm_scoring": backoff.ORACLE,
    "op6_sharding": sharding.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
}
