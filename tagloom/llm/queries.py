"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tagloom.llm import byte_bpe, chat_trees, decontamination, exact_dedup, jaccard_join, language_id, line_dedup, pii, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op5_exact_dedup": exact_dedup.query,
    "op9_pii": pii.query,
    "op8_suffix_dedup": suffix_dedup.query,
    "op10_byte_bpe": byte_bpe.query,
    "op3_jaccard_join": jaccard_join.query,
    "op2_decontamination": decontamination.query,
    "op6_line_dedup": line_dedup.query,
    "op4_chat_trees": chat_trees.query,
    "op7_language_id": language_id.query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.SQL,
    "op3_jaccard_join": jaccard_join.SQL,
    "op2_decontamination": decontamination.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op4_chat_trees": chat_trees.SQL,
}
