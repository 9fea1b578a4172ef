"""Operators for training-data corpora, and their queries. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, divergence, exact_dedup, html_extraction, language_id, line_dedup, lm_scoring, near_dedup, negatives, packing, pieces, pii, url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_language_id": language_id.op2_language_id,
        "op3_url_filters": url_filters.op3_url_filters,
        "op4_pii_surrogates": pii.op4_pii_surrogates,
        "op5_html_extraction": html_extraction.op5_html_extraction,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_decontamination": decontamination.op10_decontamination,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_best_fit_packing": packing.op13_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": line_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op10_decontamination": decontamination.SQL, "op11_source_divergence": divergence.SQL, "op12_hard_negatives": negatives.SQL}
