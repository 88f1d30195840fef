"""Chamber incubations: trimming, rates, blank correction, calcification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp_zero, ratio
from ..operators.aggregates import baseline, strict
from ..operators.joins import attach, interval_join
from ..operators.ordered import numbered
from ..operators.reshape import widen
from ..operators.verbs import keep_unless, stack
from .local_regression import ranked_local_regression

# Chamber size in mL, seconds per hour, seawater kg per litre.
CHAMBER_ML = 6000.0
SECONDS_PER_HOUR = 3600.0
SEAWATER_KG_L = 1.023


def water_volume(body_ml: Column | str, chamber_ml: float = CHAMBER_ML) -> Column:
    """Water left in a chamber; one without a body (a blank) is all water."""
    body = F.col(body_ml) if isinstance(body_ml, str) else body_ml
    return F.when(body.isNull(), F.lit(chamber_ml)).otherwise(F.lit(chamber_ml) - body)


def chamber_rates(rates: DataFrame, rate: str, body_ml: str, chamber_ml: float = CHAMBER_ML) -> DataFrame:
    """Concentration rate to amount per second: per litre rate times litres."""
    return (rates.withColumn("water_ml", water_volume(body_ml, chamber_ml))
            .withColumn("amount_rate", F.col(rate) * F.col("water_ml") * 0.001))


def blank_corrected(rates: DataFrame, block: Sequence[str], is_blank: Column, rate: str, mass: str) -> DataFrame:
    """Rate minus the mean blank of its block, per gram and hour; blanks dropped."""
    blanks = baseline(rates, block, is_blank, rate)
    joined = attach(keep_unless(rates, is_blank), blanks, block)
    per_gram_hour = SECONDS_PER_HOUR / 1000.0
    return joined.withColumns({
        "rate_corr": ratio((F.col(rate) - F.col("blank_rate")) * per_gram_hour, mass),
        "rate_uncorr": ratio(F.col(rate) * per_gram_hour, mass)})


def production_table(rates: DataFrame, ids: Sequence[str], light: str, corr: str = "rate_corr",
                     uncorr: str = "rate_uncorr", temp: str | None = None,
                     lit: str = "LIGHT", dark: str = "DARK") -> DataFrame:
    """Net production (light), respiration (dark, sign turned) and their sum.

    Negative values become 0. Rows without a corrected rate are dropped before
    the sum, so the sum may rest on one part.
    """
    temps = [temp] if temp else []
    sign = F.when(F.col(light) == dark, F.lit(-1.0)).otherwise(F.lit(1.0))
    parts = (rates.filter(F.col(light).isin(lit, dark))
             .withColumns({c: clamp_zero(F.col(c) * sign) for c in (corr, uncorr)})
             .withColumn("metric", F.when(F.col(light) == dark, "R").otherwise("NP"))
             .filter(F.col(corr).isNotNull())
             .select(*ids, light, "metric", corr, uncorr, *temps))
    gross = parts.groupBy(*ids).agg(
        clamp_zero(F.sum(corr)).alias(corr), clamp_zero(strict(F.sum, uncorr)).alias(uncorr),
        *[strict(F.avg, t).alias(t) for t in temps])
    gross = gross.withColumns({"metric": F.lit("GP"), light: F.lit(lit)})
    return stack(parts, gross.select(*parts.columns))


def alkalinity_change(samples: DataFrame, block: Sequence[str], group: str, value: str,
                      initial: str = "INITIAL") -> DataFrame:
    """Start value of the block beside each later sample, and start minus end."""
    start = widen(samples.filter(F.col(group) == initial), block, group, [initial], value)
    start = start.withColumnRenamed(initial, "initial")
    later = samples.filter(F.col(group) != initial)
    return attach(later, start, block, many=True).withColumn("drop", F.col("initial") - F.col(value))


def calcification(samples: DataFrame, run: Sequence[str], block: Sequence[str], group: str, value: str,
                  volume: str, mass: str, hours: str, blank: str = "BLANK",
                  initial: str = "INITIAL") -> DataFrame:
    """Net calcification from the drop in alkalinity, corrected by the run's blank.

    Two equivalents of alkalinity per carbonate; seawater density turns per kg
    into per litre. ``samples`` carries volume, mass and hours per row.
    """
    changed = alkalinity_change(samples, block, group, value, initial)
    blanks = (changed.filter(F.col(group) == blank).groupBy(*run)
              .agg(strict(F.avg, "drop").alias("blank_drop")))
    bodies = attach(changed.filter(F.col(group) != blank), blanks, run)
    rate = ((F.col("drop") - F.col("blank_drop")) / 2.0 * SEAWATER_KG_L
            * ratio(volume, mass) * ratio(F.lit(1.0), hours) / 1000.0)
    return bodies.withColumn("net_calcification", rate)


def metabolic_long(production: DataFrame, calcified: DataFrame, ids: Sequence[str], metric: str = "metric",
                   rate: str = "rate_corr", nc: str = "net_calcification") -> DataFrame:
    """One row per unit and metric, production rates and calcification together."""
    a = production.select(*ids, F.col(metric).alias("metric"), F.col(rate).alias("value"))
    b = calcified.select(*ids, F.lit("NC").alias("metric"), F.col(nc).alias("value"))
    return stack(a, b)


def incubation_rates(readings: DataFrame, windows: DataFrame, file: str, time: str, tie: str, value: str,
                     temp: str, skip: int = 180, thin: int = 20, alpha: float = 0.5,
                     many: bool = False) -> DataFrame:
    """Slope of every incubation from its raw readings, all files in one job.

    Interval join, warm-up rows dropped, every ``thin``-th row kept, ranked
    local regression on the row number (one reading per second) and the mean
    temperature of the rows used. One numbering serves both cuts.
    """
    inside = interval_join(readings, windows, [file], time, many=many).select(file, time, tie, value, temp)
    sec = F.col("i") - skip
    thinned = (numbered(inside, [file], [time, tie], name="i", measure=readings)
               .withColumn("sec", sec).filter((sec > 0) & (sec % thin == 0)))
    return ranked_local_regression(thinned, file, "sec", value, alpha, temp)


def drop_rerun(df: DataFrame, unit: str, name: str, channel: str, number: int) -> DataFrame:
    """Remove the spoilt measurement of a unit that was run again."""
    return keep_unless(df, (F.col(unit) == name) & (F.col(channel) == number))
