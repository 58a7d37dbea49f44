"""Queries of the training-data operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, cotrain, decontaminate, host_rules, html_extract, language, mixing, simhash, toxicity, url_filter, warc, weighted_sampling, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_host_rules": host_rules.op2_host_rules,
        "op3_cotrain": cotrain.op3_cotrain,
        "op4_html": html_extract.op4_html,
        "op5_mixing": mixing.op5_mixing,
        "op6_language": language.op6_language,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_warc": warc.op9_warc,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_weighted_sampling": weighted_sampling.op11_weighted_sampling,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_host_rules": host_rules.SQL, "op8_url_filter": url_filter.SQL, "op9_warc": warc.SQL, "op12_conversation_repair": conversation_repair.SQL}
