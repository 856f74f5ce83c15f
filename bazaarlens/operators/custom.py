"""User functions on groups, partitions and columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_group(data: DataFrame, keys: Sequence[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``function`` on each group as a pandas table; a group must fit in a worker."""
    return data.groupBy(*keys).applyInPandas(function, schema)


def per_partition(data: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``function`` on the batches of each partition."""
    return data.mapInPandas(function, schema)


def per_row(data: DataFrame, function: Callable[..., pd.Series], columns: Sequence[str], name: str, kind: str = "double") -> DataFrame:
    """A column from a vectorised function of columns."""
    return data.withColumn(name, F.pandas_udf(function, kind)(*columns))
