"""The queries of this folder and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bag_minhash, byte_bpe, conversations, decontaminate, fingerprints, html_extract, license_scan, line_dedup, merkle, quality_rules, token_ids, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_token_ids": token_ids.op2_token_ids,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_warc": warc.op5_warc,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_bag_minhash": bag_minhash.op9_bag_minhash,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_fingerprints": fingerprints.op13_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op5_warc": warc.OP5_SQL,
        "op6_license_scan": license_scan.OP6_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
        "op12_conversation_repair": conversations.OP12_SQL,
    }
