"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, langid, licenses, packing, quality, records, simhash, substring, suffix


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring": substring.op1_substring,
        "op2_html": html.op2_html,
        "op3_records": records.op3_records,
        "op4_decontaminate": decontam.op4_decontaminate,
        "op5_quality": quality.op5_quality,
        "op6_suffix": suffix.op6_suffix,
        "op7_packing": packing.op7_packing,
        "op8_language": langid.op8_language,
        "op9_licenses": licenses.op9_licenses,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring": substring.OP1_SQL,
        "op4_decontaminate": decontam.OP4_SQL,
        "op6_suffix": suffix.OP6_SQL,
        "op9_licenses": licenses.OP9_SQL,
    }
