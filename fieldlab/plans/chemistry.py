"""Water chemistry: buffer-calibrated pH, site summaries, nutrient tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import water
from ..functions.columns import recode, separate
from ..operators.aggregates import mean_se, spread
from ..operators.joins import attach, natural_join
from ..operators.reshape import lengthen
from .regression import line_fit


def ph_from_buffer(buffer: DataFrame, samples: DataFrame, by: Sequence[str], buffer_mv: str, buffer_temp: str,
                   sample_mv: str, sample_temp: str, salinity: str, name: str = "ph") -> DataFrame:
    """Total-scale pH: one buffer line per calibration, read at the sample's temperature."""
    fits = line_fit(buffer, by, buffer_temp, buffer_mv).select(*by, "slope", "intercept")
    joined = attach(samples, fits, by).withColumn(
        "tris_mv", F.col(sample_temp) * F.col("slope") + F.col("intercept"))
    return joined.withColumn(name, water.total_ph(sample_mv, "tris_mv", salinity, sample_temp))


def site_water_summary(df: DataFrame, site: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Mean, SE, minimum and maximum of each variable per site."""
    return spread(df, site, values, skip_null=False)


def nutrient_summary(df: DataFrame, sample: str, values: Sequence[str], exclude: Sequence[str],
                     labels: dict[str, str] | None = None) -> DataFrame:
    """Mean and SE per site, the site read from the sample's name."""
    parts = separate(sample, "_", ["site"])
    sites = df.withColumns(parts).filter(~F.col("site").isin(list(exclude)))
    sites = sites.withColumn("site", recode("site", labels or {}))
    long = lengthen(sites, ["site"], values)
    return mean_se(long, ["site", "parameter"], "value")


def chemistry_long(nutrients: DataFrame, alkalinity: DataFrame, keys: Sequence[str],
                   parameters: Sequence[str]) -> DataFrame:
    """Both tables on shared site and tide, one row per parameter."""
    return lengthen(natural_join(nutrients, alkalinity, "full", list(keys)), keys, parameters)


def parameter_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return mean_se(long, [*keys, "parameter"], "value")
