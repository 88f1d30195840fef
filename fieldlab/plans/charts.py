"""Tables behind the figures; drawing is left to the reader's own tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_column
from ..operators.aggregates import mean_se
from ..operators.reshape import widen
from ..operators.verbs import stack


def error_bars(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with its lower and upper standard-error ends."""
    s = mean_se(df, keys, value)
    return s.select(*keys, "mean", (F.col("mean") - F.col("se")).alias("low"),
                    (F.col("mean") + F.col("se")).alias("high"))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Counts in even bins over the range of all values; the last bin is closed."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.groupBy(*keys).agg(F.lit(None).cast("int").alias("bin"), F.count(value).alias("n"))
    width = (high - low) / bins
    at = F.lit(0) if width == 0 else F.least(
        F.lit(bins - 1), F.floor((as_column(value) - F.lit(low)) / F.lit(width)).cast("int"))
    return (df.filter(F.col(value).isNotNull()).withColumn("bin", at.cast("int"))
            .groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
            .withColumns({"low": F.lit(float(low)) + F.col("bin") * float(width),
                          "high": F.lit(float(low)) + (F.col("bin") + 1) * float(width)}))


def pair_lines(df: DataFrame, pair: Sequence[str], level: str, levels: Sequence[str], value: str) -> DataFrame:
    """Both members of each complete pair side by side."""
    wide = widen(df, pair, level, levels, value)
    return wide.dropna(subset=[str(x) for x in levels])


def plot_slice(df: DataFrame, keys: Sequence[str], metric: str, wanted: str, label: str, value: str) -> DataFrame:
    """Summary rows and raw rows of one metric, relabelled, in one table."""
    one = df.filter(F.col(metric) == wanted)
    s = mean_se(one, keys, value).select(*keys, F.lit("summary").alias("kind"), F.col("mean").alias("value"), "se")
    raw = one.select(*keys, F.lit("raw").alias("kind"), F.col(value).alias("value"),
                     F.lit(None).cast("double").alias("se"))
    return stack(s, raw).withColumn(metric, F.lit(label))
