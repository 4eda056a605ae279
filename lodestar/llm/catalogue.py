"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import binary, bpe, chat, decontaminate, fingerprints, quality, simhash, suffix, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_url_filter": urlfilter.op3_url_filter,
        "op4_chat_format": chat.op4_chat_format,
        "op5_suffix_dedup": suffix.op5_suffix_dedup,
        "op6_quality_classifier": quality.op6_quality_classifier,
        "op7_token_index": binary.op7_token_index,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_simhash_dedup": simhash.op9_simhash_dedup,
        "op10_bpe": bpe.op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.op1_sql(),
        "op2_fingerprints": fingerprints.OP2_SQL,
        "op4_chat_format": chat.OP4_SQL,
        "op5_suffix_dedup": suffix.op5_sql(),
    }
