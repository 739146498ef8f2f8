"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_exact_dedup, op2_html_text, op3_sentencepiece, op4_sharding, op5_secrets, op6_decontaminate, op7_language_id, op8_quality, op9_url_filter, op10_minhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup.op1_exact_dedup,
    "op2_html_text": op2_html_text.op2_html_text,
    "op3_sentencepiece": op3_sentencepiece.op3_sentencepiece,
    "op4_sharding": op4_sharding.op4_sharding,
    "op5_secrets": op5_secrets.op5_secrets,
    "op6_decontaminate": op6_decontaminate.op6_decontaminate,
    "op7_language_id": op7_language_id.op7_language_id,
    "op8_quality": op8_quality.op8_quality,
    "op9_url_filter": op9_url_filter.op9_url_filter,
    "op10_minhash": op10_minhash.op10_minhash,
}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": op1_exact_dedup.ORACLE_SQL, "op4_sharding": op4_sharding.oracle_sql(), "op9_url_filter": op9_url_filter.oracle_sql()}
