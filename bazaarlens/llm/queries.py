"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, language, line_dedup, maxent_lm, mixing, packing, quality, ranked_search, secret_scan, simhash, spelling, substring_dedup, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_language": language.op2_language,
    "op3_quality": quality.op3_quality,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_maxent_lm": maxent_lm.op9_maxent_lm,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_secret_scan": secret_scan.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
