"""Union of strands and wide-to-long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_strands(frames: Mapping[str, DataFrame], name: str = "strand") -> DataFrame:
    """All rows with their strand; a column that one strand lacks is null there."""
    marked = [df.withColumn(name, F.lit(strand)) for strand, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(columns), "parameter", "value")
