"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, neardup, packing, quality, rollup, substrings, suffixes, tokens, urls

QUERIES = {
    "op1_token_store": tokens.op1_token_store,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_token_rollup": rollup.op4_token_rollup,
    "op5_url_filter": urls.op5_url_filter,
    "op6_suffix_array_dedup": suffixes.op6_suffix_array_dedup,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality_rules": quality.op10_quality_rules,
}
ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": substrings.OP2_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op7_minhash_near_dedup": neardup.OP7_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op10_quality_rules": quality.OP10_SQL,
}
