"""Queries over the test tables, one for each operator, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm import byte_bpe, first_fit, framed_records, hard_negatives, language_id, oracles, order_minhash, packing, permutation_index, pitman_yor, quality, reply_trees, token_counts, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_framed_records": framed_records.query,
    "op2_quality_rules": quality.query,
    "op3_pitman_yor": pitman_yor.query,
    "op4_order_minhash": order_minhash.query,
    "op5_language_id": language_id.query,
    "op6_reply_trees": reply_trees.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_token_counts": token_counts.query,
    "op9_best_fit_packing": packing.query,
    "op10_permutation_index": permutation_index.query,
    "op11_first_fit": first_fit.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_vector_codes": vector_codes.query,
    **oracles.QUERIES,
}

ORACLE_SQL: dict[str, str] = {
    "op6_reply_trees": reply_trees.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_vector_codes": vector_codes.SQL,
    **oracles.ORACLE_SQL,
}
