"""Whole jobs from raw readings to result tables, stage by stage in a stage store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import natural_join
from ..sources.stages import StageStore
from . import respiro


def respirometry(store: StageStore, readings: DataFrame, windows: DataFrame, chambers: DataFrame, inputs: Sequence[str],
                 file: str, time: str, tie: str, value: str, temp: str, block: Sequence[str], light: str,
                 ids: Sequence[str], body_ml: str, mass: str, skip: int = 180, thin: int = 20, alpha: float = 0.5,
                 lit: str = "LIGHT", dark: str = "DARK") -> DataFrame:
    """Raw sensor readings to net production, respiration and gross production per unit.

    ``windows`` says when each file's incubation ran, ``chambers`` has a row per file
    with its block, light, unit, body volume (NULL in a blank) and mass. ``inputs``
    are the paths the tables were read from: a stage is built anew only if they, or
    a parameter before it, changed. Files without a chamber row are dropped.
    """
    fits = store.stage("incubation-rates", lambda: respiro.incubation_rates(
        readings, windows, file, time, tie, value, temp, skip, thin, alpha, many=True),
        inputs, {"skip": skip, "thin": thin, "alpha": alpha, "columns": [file, time, tie, value, temp]})

    def corrected() -> DataFrame:
        rows = natural_join(fits.select(file, "slope", F.col("mean_temp").alias(temp)), chambers, "inner", [file])
        amounts = respiro.chamber_rates(rows, "slope", body_ml)
        return respiro.blank_corrected(amounts, list(block), F.col(body_ml).isNull(), "amount_rate", mass)
    rates = store.stage("blank-corrected", corrected, ["incubation-rates", *inputs], {"block": list(block), "columns": [body_ml, mass]})
    return store.stage("production", lambda: respiro.production_table(rates, ids, light, temp=temp, lit=lit, dark=dark),
                       ["blank-corrected"], {"ids": list(ids), "columns": [light, temp], "marks": [lit, dark]})
