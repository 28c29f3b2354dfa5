"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from mirage.llm import (op1_substrings, op2_url_filter, op3_quality, op4_toxicity, op5_jaccard, op6_warc, op7_tokens, op8_mixing, op9_packing,
                        op10_simhash, op11_alignment, op12_tree_dedup, op13_repair)

QUERIES = {
    "op1_substring_dedup": op1_substrings.op1_substring_dedup,
    "op2_url_filter": op2_url_filter.op2_url_filter,
    "op3_quality_rules": op3_quality.op3_quality_rules,
    "op4_toxicity": op4_toxicity.op4_toxicity,
    "op5_ngram_jaccard_join": op5_jaccard.op5_ngram_jaccard_join,
    "op6_warc_zstd": op6_warc.op6_warc_zstd,
    "op7_token_counts": op7_tokens.op7_token_counts,
    "op8_temperature_mixing": op8_mixing.op8_temperature_mixing,
    "op9_best_two_fit_packing": op9_packing.op9_best_two_fit_packing,
    "op10_simhash": op10_simhash.op10_simhash,
    "op11_tokenizer_alignment": op11_alignment.op11_tokenizer_alignment,
    "op12_tree_merge_dedup": op12_tree_dedup.op12_tree_merge_dedup,
    "op13_conversation_repair": op13_repair.op13_conversation_repair,
}
ORACLE = {
    "op2_url_filter": op2_url_filter.SQL,
    "op6_warc_zstd": op6_warc.SQL,
    "op8_temperature_mixing": op8_mixing.SQL,
    "op3_quality_rules": op3_quality.SQL,
    "op12_tree_merge_dedup": op12_tree_dedup.SQL,
}
