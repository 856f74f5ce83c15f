"""Tidy result tables (A10): one line per model and test, and the wide form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tidy(results: dict[str, DataFrame], key: str, statistic: str = "statistic", p: str = "p_value", verdict: str | None = None) -> DataFrame:
    """(key, test, stat, p_value, verdict) from several test tables."""
    parts = []
    for name, df in results.items():
        word = F.col(verdict).cast("string") if verdict and verdict in df.columns else F.lit(None).cast("string")
        test = F.col("test") if "test" in df.columns else F.lit(name)
        parts.append(df.select(key, test.alias("test"), F.col(statistic).alias("stat"), (F.col(p) if p in df.columns else F.lit(None).cast("double")).alias("p_value"), word.alias("verdict")))
    return reduce(DataFrame.unionAll, parts)


def wide(rows: DataFrame, key: str, tests: Sequence[str] | None = None) -> DataFrame:
    """key with <test>_stat, <test>_pval and <test>_result."""
    return rows.groupBy(key).pivot("test", list(tests) if tests else None).agg(F.first("stat").alias("stat"), F.first("p_value").alias("pval"), F.first("verdict").alias("result"))
