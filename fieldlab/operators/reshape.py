"""Long to wide and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widen(df: DataFrame, ids: Sequence[str], names: str, levels: Sequence, values: str) -> DataFrame:
    """One column per level, one value per cell, in one aggregate.

    A second value in a cell is an error of the input and stops the query.
    """
    cells = []
    for level in levels:
        hit = F.when(F.col(names) == F.lit(level), F.col(values))
        twice = F.count(F.when(F.col(names) == F.lit(level), 1)) > 1
        cells.append(F.when(twice, F.raise_error(F.lit(f"more than one value in cell {level}"))
                            .cast(df.schema[values].dataType))
                     .otherwise(F.max(hit)).alias(str(level)))
    return df.groupBy(*ids).agg(*cells)


def counts_wide(df: DataFrame, ids: Sequence[str], names: str, levels: Sequence) -> DataFrame:
    return df.groupBy(*ids).pivot(names, list(levels)).count()


def lengthen(df: DataFrame, ids: Sequence[str], values: Sequence[str],
             name: str = "parameter", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)
