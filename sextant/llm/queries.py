"""The corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import image_copies, language_id, line_dedup, mixing, near_dedup, negatives, pieces, quality_classifier, quality_rules, repeats, simhash, token_files, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_mixing": mixing.op2_mixing,
        "op3_language_id": language_id.op3_language_id,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_quality_classifier": quality_classifier.op5_quality_classifier,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_repeats": repeats.op7_repeats,
        "op8_image_copies": image_copies.op8_image_copies,
        "op9_token_files": token_files.op9_token_files,
        "op10_pieces": pieces.op10_pieces,
        "op11_whitening": whitening.op11_whitening,
        "op12_simhash": simhash.op12_simhash,
        "op13_hard_negatives": negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": near_dedup.ORACLE, "op6_line_dedup": line_dedup.ORACLE, "op7_repeats": repeats.ORACLE, "op13_hard_negatives": negatives.ORACLE}
