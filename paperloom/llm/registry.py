"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from paperloom.llm import bpe, embedding_dedup, exact_dedup, language_id, line_quality, packing, periodic_runs, pii, prefix_trie, quality, simhash, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_simhash": simhash.op2_simhash,
        "op3_language_id": language_id.op3_language_id,
        "op4_quality": quality.op4_quality,
        "op5_pii": pii.op5_pii,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_bpe": bpe.op7_bpe,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_line_quality": line_quality.op12_line_quality,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op9_embedding_dedup": embedding_dedup.OP9_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_line_quality": line_quality.OP12_SQL,
        "op13_periodic_runs": periodic_runs.OP13_SQL,
    }
