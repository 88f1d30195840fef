"""Logger jobs and the flagship query, on the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import daily, mean_se
from ..operators.joins import attach
from ..plans import anova, loggers
from ..session import settle
from ..sources import tables as S
from .joins import outages, outages_sql
from .registry import query

LOGGER_SQL = "(SELECT event_id, ts, user_id % 4 AS logger, value FROM events)"


def series(t) -> DataFrame:
    return t.events.select("event_id", "ts", (F.col("user_id") % 4).alias("logger"), "value")


def instants(t) -> DataFrame:
    """First reading at least a day in, and last one before mid month, per logger."""
    s = series(t)
    begin = s.agg(F.min("ts")).first()[0]
    after = F.col("ts") >= F.lit(begin) + F.expr("INTERVAL 1 DAY")
    before = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    return settle(s.groupBy("logger").agg(F.min(F.when(after, F.col("ts"))).alias("start"),
                                          F.max(F.when(before, F.col("ts"))).alias("stop")))


INSTANTS_SQL = f"""(SELECT logger, min(ts) FILTER (ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY) AS start,
    max(ts) FILTER (ts < TIMESTAMP '2024-01-15') AS stop FROM {LOGGER_SQL} GROUP BY 1)"""


@query("C21_one_point_calibration", f"""
    SELECT event_id, logger, round(value + o.shift, 6) AS calibrated FROM {LOGGER_SQL} JOIN
      (SELECT logger, 35.5 + logger - avg(value) AS shift FROM {LOGGER_SQL} JOIN {INSTANTS_SQL} USING (logger)
       WHERE ts BETWEEN start AND stop GROUP BY logger) o USING (logger)""")
def c21(t):
    refs = instants(t).withColumn("reference", 35.5 + F.col("logger"))
    c = loggers.one_point_calibration(series(t), refs, "logger", "ts", "value")
    return c.select("event_id", "logger", F.round("calibrated", 6).alias("calibrated"))


#: Reference conductivity, reference temperature (none for one logger) and flag of each logger
REFERENCE_CELLS = ((0, 52.5, 24.5, "EC"), (1, 53.25, 26.0, "SC"), (2, 51.0, None, "SC"), (3, 54.0, None, "EC"))
CHANNELS_SQL = """(SELECT event_id, ts, user_id % 4 AS logger, 50 + user_id % 12 + value / 1000 AS ec, 20 + user_id % 9 + value / 500 AS temp
    FROM events)"""


@query("C21_two_channel_calibration", f"""
    WITH refs(logger, ref, ref_t, flag) AS (VALUES {", ".join(f"({k}, {c}, {'NULL' if t is None else t}, '{flag}')" for k, c, t, flag in REFERENCE_CELLS)}),
    means AS (SELECT logger, avg(ec) AS c, avg(temp) AS t FROM {CHANNELS_SQL} JOIN {INSTANTS_SQL} USING (logger)
              WHERE ts BETWEEN start AND stop GROUP BY logger),
    shifts AS (SELECT logger, coalesce(ref_t, t) - t AS dt,
                      CASE flag WHEN 'EC' THEN ref ELSE ref * (1 + 0.0191 * (coalesce(ref_t, t) - 25)) END - c AS dc
               FROM refs JOIN means USING (logger))
    SELECT event_id, logger, round(temp + dt, 6) AS temperature_cal, round(ec + dc, 6) AS conductivity_cal,
           round((ec + dc) / (1 + 0.0191 * (temp + dt - 25)), 6) AS specific_cal
    FROM {CHANNELS_SQL} JOIN shifts USING (logger)""")
def c21_channels(t):
    rows = S.literal_table(t.spark, REFERENCE_CELLS, "logger int, reference double, reference_temperature double, flag string")
    refs = instants(t).join(F.broadcast(rows), "logger")
    channels = t.events.select("event_id", "ts", (F.col("user_id") % 4).alias("logger"),
                               (50 + F.col("user_id") % 12 + F.col("value") / 1000).alias("ec"),
                               (20 + F.col("user_id") % 9 + F.col("value") / 500).alias("temp"))
    c = loggers.two_channel_calibration(channels, refs, "logger", "ts", "ec", "temp")
    return c.select("event_id", "logger", *[F.round(n, 6).alias(n) for n in ("temperature_cal", "conductivity_cal", "specific_cal")])


OFFSET_SQL = f"""(SELECT event_id, logger, ts, value + 36.0 + logger - at_cal AS corrected FROM {LOGGER_SQL} JOIN
    (SELECT logger, stop, value AS at_cal FROM {INSTANTS_SQL} i JOIN {LOGGER_SQL} s USING (logger) WHERE s.ts = i.stop)
    USING (logger) WHERE ts >= stop)"""


@query("C22_offset_after", f"SELECT event_id, logger, round(corrected, 6) AS corrected FROM {OFFSET_SQL}")
def c22(t):
    refs = instants(t).select("logger", F.col("stop").alias("at"), (36.0 + F.col("logger")).alias("reference"))
    c = loggers.offset_after(series(t), refs, "logger", "ts", "value")
    return c.select("event_id", "logger", F.round("corrected", 6).alias("corrected"))


DRIFT_SQL = f"""(SELECT event_id, logger, ts, i, n, value + d1 + i * (d2 - d1) / n AS corrected FROM
    (SELECT *, 35.0 + logger - first_value(value) OVER w AS d1, 36.0 + logger - last_value(value) OVER w AS d2,
            row_number() OVER (PARTITION BY logger ORDER BY ts, event_id) AS i, count(*) OVER w AS n
     FROM {LOGGER_SQL} JOIN {INSTANTS_SQL} USING (logger) WHERE ts BETWEEN start AND stop
     WINDOW w AS (PARTITION BY logger ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    WHERE ts <> stop)"""


def references(t) -> DataFrame:
    return instants(t).withColumns({"ref_start": 35.0 + F.col("logger"), "ref_stop": 36.0 + F.col("logger")})


@query("C23_drift_correction", f"SELECT event_id, logger, i, n, round(corrected, 6) AS corrected FROM {DRIFT_SQL}")
def c23(t):
    d = loggers.drift_corrected(series(t), references(t), "logger", "ts", "event_id", "value")
    return d.select("event_id", "logger", "i", "n", F.round("corrected", 6).alias("corrected"))


@query("C23_recalibrated_series", f"""
    SELECT event_id, logger, round(corrected, 6) AS corrected FROM {DRIFT_SQL}
    UNION ALL SELECT event_id, logger, round(corrected, 6) FROM {OFFSET_SQL}""")
def c23_both(t):
    r = loggers.recalibrated(series(t), references(t), "logger", "ts", "event_id", "value")
    return r.select("event_id", "logger", F.round("corrected", 6).alias("corrected"))


CALIBRATIONS = (
    (0, "1/2/2024", "pre", "6:00", "6:30"),
    (0, "1/20/2024", "post", "11:00", "12:00"),
    (1, "1/2/2024", "pre", "6:00:00", "6:20"),
    (1, "1/9/2024", "pre", "7:00", "7:20"),
    (2, "1/20/2024", "post", "11:10", "12:00:00"),
    (3, "1/2/2024", "pre", "6:00", "6:10"),
)
LAUNCHES = (
    ("CT_0", "1/2/2024 6:00", "1/20/2024 12:00"),
    ("CT_1", "1/3/2024 6:00", "1/19/2024 12:00"),
    ("CT_2", "1/4/2024 0:00", "1/18/2024 0:00"),
    ("CT_3", "1/2/2024 6:00", "1/20/2024 12:00"),
)


@query("C24_deployment_crop", """
    SELECT logger, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(sum(value), 4) AS total FROM
      (SELECT ts, user_id % 4 AS logger, value FROM events) JOIN (VALUES
        (0, TIMESTAMP '2024-01-02 06:00:00', TIMESTAMP '2024-01-20 12:00:00'),
        (1, TIMESTAMP '2024-01-03 06:00:00', TIMESTAMP '2024-01-19 12:00:00'),
        (2, TIMESTAMP '2024-01-04 00:00:00', TIMESTAMP '2024-01-18 00:00:00')) d(logger, lo, hi) USING (logger)
    WHERE ts BETWEEN lo AND hi GROUP BY 1""")
def c24(t):
    from ..functions.columns import parse_time, separate
    log = S.literal_table(t.spark, CALIBRATIONS, "logger bigint, date string, pre_post string, time_in string, time_out string")
    cal = loggers.calibration_events(log, [0, 1, 2], "2024-01-02 06:00:00", "2024-01-20 12:00:00", "logger")
    lau = S.literal_table(t.spark, LAUNCHES, "serial string, launched string, retrieved string")
    lau = lau.withColumns({**separate("serial", "_", [None, "logger"]),
                           "launched": parse_time("launched"), "retrieved": parse_time("retrieved")})
    lau = lau.withColumn("logger", F.col("logger").cast("bigint"))
    used = loggers.launches_for(lau, cal, "logger")
    cropped = loggers.crop(series(t), used, "logger", "ts", "launched", "retrieved")
    return cropped.groupBy("logger").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"),
                                         F.max("ts").alias("last_ts"), F.round(F.sum("value"), 4).alias("total"))


QC_SQL = """(SELECT * FROM events e WHERE ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28 06:00:00'
    AND user_id % 4 <> 2 AND value > 5 AND """ + outages_sql() + ")"


def controlled(t) -> DataFrame:
    rows = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return loggers.quality_controlled(rows, "ts", "2024-01-02 00:00:00", "2024-01-28 06:00:00",
                                      F.col("user_id") % 4 != 2, "value", 5.0, outages(t), "event_type")


@query("C25_quality_control", f"SELECT event_id, event_type, ts, value FROM {QC_SQL}")
def c25(t):
    return controlled(t).select("event_id", "event_type", "ts", "value")


DAYS_SQL = """(SELECT event_type, CAST(ts AS DATE) AS day, max(value) - min(value) AS r FROM {} GROUP BY ALL)"""


@query("C26_daily_range_summary", f"""
    SELECT event_type, round(avg(r), 7) AS mean_range, round(stddev_samp(r), 7) AS sd_range,
           round(stddev_samp(r)/sqrt(count(r)), 8) AS se_range FROM {DAYS_SQL.format('events')} GROUP BY 1""")
def c26(t):
    s = loggers.daily_range_summary(t.events, "event_type", "ts", "value")
    return s.withColumns({"mean_range": F.round("mean_range", 7), "sd_range": F.round("sd_range", 7),
                          "se_range": F.round("se_range", 8)})


@query("C27_water_levels", """
    SELECT hour, logger, round(depth, 7) AS depth, kind, round(salinity, 7) AS salinity FROM
      (SELECT date_trunc('hour', ts) AS hour, user_id % 4 AS logger, event_type AS kind, -sum(value) AS depth FROM events
       WHERE event_type IN ('click', 'view') AND date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25 06:00:00'
       GROUP BY ALL)
    FULL JOIN (SELECT date_trunc('hour', ts) AS hour, user_id % 4 AS logger, avg(value) AS salinity FROM events
               WHERE event_type = 'signup' GROUP BY ALL) USING (hour, logger)""")
def c27(t):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    logger = (F.col("user_id") % 4).alias("logger")

    def file(kind):
        one = t.events.filter(F.col("event_type") == kind).groupBy(hour, logger)
        return one.agg(F.sum("value").alias("depth"), F.lit(kind).alias("kind"))
    levels = loggers.water_levels([file("click"), file("view")], "hour", "depth", "2024-01-03 00:00:00", "2024-01-25 06:00:00")
    salt = t.events.filter("event_type = 'signup'").groupBy(hour, logger).agg(F.avg("value").alias("salinity"))
    both = loggers.with_water_levels(salt, levels, ["hour", "logger"])
    return both.select("hour", "logger", F.round("depth", 7).alias("depth"), "kind", F.round("salinity", 7).alias("salinity"))


@query("C28_logger_summary", f"""
    SELECT logger, round(avg(value), 7) AS mean_v, round(stddev_samp(value)/sqrt(count(value)), 8) AS se_v, min(value) AS min_v,
           max(value) AS max_v, round(max(value) - min(value), 6) AS range_v FROM {LOGGER_SQL} GROUP BY 1""")
def c28(t):
    s = loggers.logger_summary(series(t), "logger", {"value": "v"})
    return s.withColumns({"mean_v": F.round("mean_v", 7), "se_v": F.round("se_v", 8), "range_v": F.round("range_v", 6)})


@query("flagship_daily_range", f"""
    WITH d AS {DAYS_SQL.format(QC_SQL)},
    c AS (SELECT event_type, count(*) AS n, avg(r) AS m, var_pop(r) * count(*) AS ss, stddev_samp(r)/sqrt(count(r)) AS se FROM d GROUP BY 1),
    g AS (SELECT sum(n * m) / sum(n) AS grand, count(*) - 1 AS df1, sum(n) - count(*) AS df2, sum(ss) AS ssr FROM c),
    f AS (SELECT df1, df2, (sum(n * (m - grand)**2) / df1) / (ssr / df2) AS f_value FROM c, g GROUP BY df1, df2, ssr)
    SELECT event_type, round(m, 6) AS mean_range, round(se, 7) AS se_range, df1 AS df_factor, CAST(df2 AS BIGINT) AS df_residual,
           round(f_value, 6) AS f_value, round(x**(df2/2) * (1 + df2/2 * (1 - x)), 9) AS p
    FROM c, (SELECT *, df2 / (df2 + df1 * f_value) AS x FROM f)""")
def flagship(t):
    """Controlled readings -> daily range -> mean and SE per group -> one-way test."""
    days = settle(daily(controlled(t), ["event_type"], "ts", {"value": "value"}))
    means = mean_se(days, ["event_type"], "range_value", ("mean_range", "sd_range", "se_range"))
    test = anova.one_way(days.withColumn("study", F.lit(1)), ["study"], "event_type", "range_value")
    out = attach(means.withColumn("study", F.lit(1)), test, ["study"])
    return out.select("event_type", F.round("mean_range", 6).alias("mean_range"), F.round("se_range", 7).alias("se_range"),
                      "df_factor", "df_residual", F.round("f_value", 6).alias("f_value"), F.round("p", 9).alias("p"))
