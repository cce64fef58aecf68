"""The operators of this subpackage as queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platewise.llm import (
    bpe_stream,
    decontamination,
    hard_negatives,
    html_extraction,
    language_id,
    lexical_search,
    license_scan,
    packing,
    quality_rules,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
)
from platewise.llm.oracle import oracle_sql

__all__ = ["oracle_sql", "queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_simhash": simhash.op2_simhash,
        "op3_token_files": token_files.op3_token_files,
        "op4_packing": packing.op4_packing,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_language_id": language_id.op7_language_id,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_html_extraction": html_extraction.op10_html_extraction,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_bpe_stream": bpe_stream.op12_bpe_stream,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }
