"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from setweave.llm import arrow_output, bpe, language_id, mixing, near_dedup, quality_pu, quality_rules, token_counts, toxicity, vector_search

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_near_dedup,
        quality_pu.op2_quality_pu,
        bpe.op3_byte_bpe,
        toxicity.op4_toxicity,
        quality_rules.op5_quality_rules,
        token_counts.op6_token_counts,
        arrow_output.op7_arrow_output,
        vector_search.op8_vector_search,
        mixing.op9_mixing,
        language_id.op10_language_id,
    )
}

#: The others fit models or follow a tokenizer; tests hold them against brute force, libraries, or held-out labels.
ORACLE_SQL = {"op5_quality_rules": quality_rules.ORACLE, "op8_vector_search": vector_search.ORACLE, "op9_mixing": mixing.ORACLE}
