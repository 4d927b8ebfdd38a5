"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cover_dedup, decontaminate, exact_topk, filter_audit, fingerprints, hard_negatives, html_text, lm_score, mixing, near_dup, quality, suffix_dedup, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash": near_dup.op1_dart_minhash,
    "op2_column_suffix_dedup": suffix_dedup.op2_column_suffix_dedup,
    "op3_cover_dedup": cover_dedup.op3_cover_dedup,
    "op4_repair_tokens": token_store.op4_repair_tokens,
    "op5_pivotal_mix": mixing.op5_pivotal_mix,
    "op6_cross_entropy_difference": lm_score.op6_cross_entropy_difference,
    "op7_qda_quality": quality.op7_qda_quality,
    "op8_winnowing": decontaminate.op8_winnowing,
    "op9_iblt_fingerprints": fingerprints.op9_iblt_fingerprints,
    "op10_tag_path_text": html_text.op10_tag_path_text,
    "op11_survival_words": filter_audit.op11_survival_words,
    "op12_impact_topk": exact_topk.op12_impact_topk,
    "op13_rns_negatives": hard_negatives.op13_rns_negatives,
}

ORACLE: dict[str, str] = {
    "op3_cover_dedup": cover_dedup.ORACLE_SQL,
    "op8_winnowing": decontaminate.ORACLE_SQL,
    "op11_survival_words": filter_audit.ORACLE_SQL,
    "op12_impact_topk": exact_topk.ORACLE_SQL,
    "op13_rns_negatives": hard_negatives.ORACLE_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
