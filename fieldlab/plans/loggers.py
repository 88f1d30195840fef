"""Logger series: calibration, drift, quality control, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import water
from ..functions.columns import parse_date_and_time
from ..operators.aggregates import daily, mean_se, spread
from ..operators.joins import align, attach, exclude_windows, interval_join, lookup_at, natural_join
from ..operators.ordered import numbered
from ..operators.verbs import stack


def with_salinity(series: DataFrame, conductivity: str, temperature: str, pressure: float = 10.0,
                  name: str = "salinity") -> DataFrame:
    return series.withColumn(name, water.practical_salinity(conductivity, temperature, pressure))


def one_point_calibration(series: DataFrame, references: DataFrame, key: str, time: str,
                          value: str, reference: str = "reference", start: str = "start",
                          stop: str = "stop", name: str = "calibrated") -> DataFrame:
    """Add (reference - mean reading in the calibration window) to the series.

    One reference row per logger; a logger without readings in its window keeps
    NULL, so a failed calibration is seen.
    """
    inside = interval_join(series.select(key, time, value), references.select(key, start, stop, reference),
                           [key], time, start, stop)
    offset = inside.groupBy(key).agg((F.max(reference) - F.avg(value)).alias("offset"))
    return attach(series, offset, [key]).withColumn(name, F.col(value) + F.col("offset"))


def two_channel_calibration(series: DataFrame, references: DataFrame, key: str, time: str, conductivity: str,
                            temperature: str, reference: str = "reference", reference_temperature: str = "reference_temperature",
                            flag: str = "flag", start: str = "start", stop: str = "stop",
                            per_degree: float = water.COMPENSATION) -> DataFrame:
    """One-point calibration of a conductivity logger and its thermometer, in one pass over the calibration window.

    The thermometer is shifted by (reference temperature - mean reading in the
    window); without a reference temperature it stays as it is. The flag says what
    the reference conductivity is: ``EC``, as measured, or ``SC``, at 25 degrees C;
    the latter is first brought to the calibrated temperature of the window. The
    conductivity is then shifted by (reference - mean reading). Adds
    ``temperature_cal``, ``conductivity_cal`` and ``specific_cal`` (at 25 degrees).

    One reference row per logger. A logger without a row, without readings in its
    window, with a NULL reference or with another flag keeps NULL in the
    conductivities, so a failed calibration is seen.
    """
    windows = references.select(key, start, stop, F.col(reference).alias("_ref"), F.col(reference_temperature).alias("_ref_t"),
                                F.upper(F.col(flag)).alias("_flag"))
    inside = interval_join(series.select(key, time, conductivity, temperature), windows, [key], time, start, stop)
    means = inside.groupBy(key).agg(F.avg(conductivity).alias("c"), F.avg(temperature).alias("t"), F.max("_ref").alias("ref"),
                                    F.max("_ref_t").alias("ref_t"), F.max("_flag").alias("flag"))
    at = F.coalesce("ref_t", "t")
    target = F.when(F.col("flag") == "EC", F.col("ref")).when(F.col("flag") == "SC", water.conductivity_at("ref", at, per_degree))
    shifts = means.select(key, (target - F.col("c")).alias("_dc"), (at - F.col("t")).alias("_dt"))
    out = attach(series, shifts, [key]).withColumns({"temperature_cal": F.col(temperature) + F.coalesce("_dt", F.lit(0.0)),
                                                     "conductivity_cal": F.col(conductivity) + F.col("_dc")})
    return out.withColumn("specific_cal", water.specific_conductance("conductivity_cal", "temperature_cal", per_degree)).drop("_dc", "_dt")


def offset_after(series: DataFrame, references: DataFrame, key: str, time: str, value: str,
                 at: str = "at", reference: str = "reference", name: str = "corrected") -> DataFrame:
    """From the calibration instant on, shift by (reference - reading at it)."""
    instants = references.select(F.col(key), F.col(at).alias(time), F.col(reference).alias("ref"))
    found = lookup_at(series.select(key, time, value), instants, [key], time)
    shift = found.groupBy(key).agg(F.max(F.col("ref") - F.col(value)).alias("offset"),
                                   F.max(time).alias("since"))
    return (attach(series, shift, [key], "inner").filter(F.col(time) >= F.col("since"))
            .withColumn(name, F.col(value) + F.col("offset")).drop("since"))


def drift_corrected(series: DataFrame, references: DataFrame, key: str, time: str, tie: str, value: str,
                    start: str = "start", stop: str = "stop", ref_start: str = "ref_start",
                    ref_stop: str = "ref_stop", name: str = "corrected", drop_last: bool = True,
                    rows_per_task: int | None = None) -> DataFrame:
    """Spread the drift between two references over the rows between them.

    d1 is the offset at the first row and d2 at the last; row i of n gets
    d1 + i (d2 - d1) / n. The row at the second reference is dropped, since the
    later part of the series starts with it. A long logger
    is numbered in time slices, so it does not end in one task.
    """
    inside = interval_join(series, references, [key], time, start, stop)
    sizes = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    out = numbered(inside, [key], [time, tie], name="i", total="n", ends=value, measure=series, **sizes)
    d1 = F.col(ref_start) - F.col("first_value")
    d2 = F.col(ref_stop) - F.col("last_value")
    out = out.withColumn(name, F.col(value) + d1 + F.col("i") * (d2 - d1) / F.col("n"))
    if drop_last:
        out = out.filter(F.col(time) != F.col(stop))
    return out.select(*series.columns, "i", "n", name)


def recalibrated(series: DataFrame, references: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Drift correction up to the mid reference, constant offset after it.

    ``references`` has one row per logger: start, stop, ref_start, ref_stop; the
    second pair is also the instant and value of the later offset.
    """
    before = drift_corrected(series, references, key, time, tie, value).select(*series.columns, "corrected")
    later = offset_after(series, references.select(key, F.col("stop").alias("at"),
                                                   F.col("ref_stop").alias("reference")),
                         key, time, value).select(*series.columns, "corrected")
    return stack(before, later)


def calibration_events(log: DataFrame, trusted: Sequence, begin, end, logger: str = "logger_id",
                       date: str = "date", time_in: str = "time_in", time_out: str = "time_out",
                       phase: str = "pre_post") -> DataFrame:
    """Calibrations at the start (pre) or end (post) of a deployment."""
    t_in, t_out = parse_date_and_time(date, time_in), parse_date_and_time(date, time_out)
    wanted = (((t_in == F.lit(begin).cast("timestamp_ntz")) & (F.col(phase) == "pre"))
              | ((t_out == F.lit(end).cast("timestamp_ntz")) & (F.col(phase) == "post")))
    return (log.filter(F.col(logger).isin(list(trusted))).filter(wanted)
            .withColumns({time_in: t_in, time_out: t_out}))


def launches_for(launches: DataFrame, calibrations: DataFrame, key: str) -> DataFrame:
    """Launch rows of calibrated loggers; a logger without a launch stays with NULLs."""
    return natural_join(launches, calibrations.select(key).distinct(), "right", [key])


def crop(series: DataFrame, deployments: DataFrame, key: str, time: str, start: str, stop: str) -> DataFrame:
    """Readings between launch and retrieval of their logger."""
    return interval_join(series, deployments.select(key, start, stop).distinct(), [key], time,
                         start, stop).drop(start, stop)


def quality_controlled(series: DataFrame, time: str, begin, end, trusted: Column, value: str, floor: float,
                       windows: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Study period, trusted loggers and submerged readings, without bad windows."""
    kept = series.filter(F.col(time).between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
                         & trusted & (F.col(value) > floor))
    return kept if windows is None else exclude_windows(kept, windows, group, time)


def daily_range_summary(series: DataFrame, group: str, time: str, value: str) -> DataFrame:
    """Mean and SE over days of the daily range."""
    days = daily(series, [group], time, {value: "value"})
    return mean_se(days, [group], "range_value", ("mean_range", "sd_range", "se_range"))


def water_levels(files: Sequence[DataFrame], time: str, depth: str, begin, end) -> DataFrame:
    """Depth loggers of several files as one table, depth counted downwards."""
    return (stack(*files).filter(F.col(time).between(F.lit(begin).cast("timestamp_ntz"),
                                                     F.lit(end).cast("timestamp_ntz")))
            .withColumn(depth, -F.col(depth)))


def with_water_levels(series: DataFrame, levels: DataFrame, on: Sequence[str]) -> DataFrame:
    return align(series, levels, on)


def logger_summary(series: DataFrame, key: str, values: dict[str, str]) -> DataFrame:
    return spread(series, [key], values)
