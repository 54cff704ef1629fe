"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, html_extraction, importance, language_id, lexical_search, lm_scoring, merkle, pii, secrets, sharding, simhash


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_secrets": secrets.op3_secrets,
        "op4_html": html_extraction.op4_html,
        "op5_lm": lm_scoring.op5_lm,
        "op6_bpe": bpe.op6_bpe,
        "op7_chat": chat.op7_chat,
        "op8_simhash": simhash.op8_simhash,
        "op9_language_id": language_id.op9_language_id,
        "op10_merkle": merkle.op10_merkle,
        "op11_importance": importance.op11_importance,
        "op12_search": lexical_search.op12_search,
        "op13_pii": pii.op13_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.oracle_sql(),
        "op2_decontamination": decontamination.ORACLE_SQL,
        "op7_chat": chat.ORACLE_SQL,
        "op11_importance": importance.ORACLE_SQL,
        "op12_search": lexical_search.ORACLE_SQL,
    }
