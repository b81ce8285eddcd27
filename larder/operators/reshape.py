"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(
    df: DataFrame,
    ids: Sequence[str],
    measures: Sequence[str],
    name: str = "measure_name",
    value: str = "value",
    keep_nulls: bool = True,
) -> DataFrame:
    """One row per id and measure. NULLs stay by default: a missing value is a fact of its own."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    long = wide.unpivot(list(ids), list(measures), name, value)
    return long if keep_nulls else long.filter(F.col(value).isNotNull())


def pivot_measures(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    name: str = "measure_name",
    value: str = "value",
) -> DataFrame:
    """One column per listed measure: the largest value under that name."""
    rows = df.filter(F.col(name).isin(*measures))
    cells = [F.max(F.when(F.col(name) == m, F.col(value))).alias(m) for m in measures]
    return rows.groupBy(*keys).agg(*cells)
