"""Whole jobs over the given tables, kept stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..plans import chains
from ..sources.stages import StageStore
from .biology import SERIES_SQL
from .joins import user_windows
from .local_sql import ranked_local_regression_sql
from .registry import query


def store_of(t, name: str) -> StageStore:
    """A store of this call's own: a query's rows must not depend on an earlier call."""
    return StageStore(t.spark, f"{name}-{uuid.uuid4().hex}", keep=True)


@query("S6_stage_store", """
    WITH clean AS (SELECT event_id, user_id, event_type, value FROM events WHERE value IS NOT NULL),
    patched AS (SELECT event_id, user_id, event_type, CASE WHEN event_type = 'error' THEN 2 * value ELSE value END AS value FROM clean)
    SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, (SELECT count(*) FROM clean) AS manifest_rows FROM patched GROUP BY ALL""")
def s6_store(t):
    store, source = store_of(t, "events"), f"{t.folder}/events.parquet"
    store.stage("clean", lambda: t.events.select("event_id", "user_id", "event_type", "value").where("value IS NOT NULL"),
                [source], partition_by=["event_type"])
    again = t.events.select("event_id", "user_id", "event_type", (2 * F.col("value")).alias("value")).where(
        "value IS NOT NULL AND event_type = 'error'")
    patched = store.replace_partitions("clean", again, ["event_type"])
    sums = store.stage("sums", lambda: patched.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")), ["clean"])
    # A stage has one manifest row.
    rows = store.manifests().where("stage = 'clean'").select("stage", F.col("n_rows").alias("manifest_rows"))
    return sums.withColumn("stage", F.lit("clean")).join(F.broadcast(rows), "stage").drop("stage")


CHAMBER_SQL = f"""(SELECT user_id, slope, mean_temp AS temp, user_id % 3 AS block, user_id % 2 AS dark, user_id // 2 AS unit,
    CASE WHEN user_id % 5 <> 0 THEN 100.0 + user_id % 50 END AS body, 1 + user_id % 7 AS mass
    FROM ({ranked_local_regression_sql(f"(SELECT user_id AS file, CAST(sec AS DOUBLE) AS x, value AS y FROM {SERIES_SQL})")})
    JOIN (SELECT user_id, avg(temp) AS mean_temp FROM {SERIES_SQL} GROUP BY 1) ON user_id = file)"""


@query("chain_respirometry", f"""
    WITH amounts AS MATERIALIZED (SELECT *, slope * (6000 - coalesce(body, 0)) * 0.001 AS amount FROM {CHAMBER_SQL}),
    rates AS (SELECT unit, dark, temp, CASE dark WHEN 1 THEN -1 ELSE 1 END * (amount - blank) * 3.6 / mass AS corr,
                     CASE dark WHEN 1 THEN -1 ELSE 1 END * amount * 3.6 / mass AS uncorr
              FROM amounts LEFT JOIN (SELECT block, dark, avg(amount) AS blank FROM amounts WHERE body IS NULL GROUP BY ALL) USING (block, dark)
              WHERE body IS NOT NULL),
    parts AS (SELECT unit, CASE dark WHEN 1 THEN 'R' ELSE 'NP' END AS metric, CASE WHEN corr < 0 THEN 0 ELSE corr END AS corr,
                     CASE WHEN uncorr < 0 THEN 0 ELSE uncorr END AS uncorr, temp FROM rates WHERE corr IS NOT NULL)
    SELECT unit, metric, round(corr, 4) AS rate_corr, round(uncorr, 4) AS rate_uncorr, round(temp, 5) AS temp FROM
      (SELECT * FROM parts UNION ALL SELECT unit, 'GP', sum(corr), sum(uncorr), avg(temp) FROM parts GROUP BY unit)""")
def respirometry(t):
    user = F.col("user_id")
    readings = t.events.select("user_id", "ts", "event_id", "value", (20.0 + user % 12).alias("temp"))
    windows = user_windows(t, 1, -1)
    chambers = windows.select("user_id", (user % 3).alias("block"), F.when(user % 2 == 1, "DARK").otherwise("LIGHT").alias("light"),
                              F.floor(user / 2).alias("unit"), F.when(user % 5 != 0, 100.0 + user % 50).alias("body_ml"),
                              (1 + user % 7).alias("mass"))
    made = chains.respirometry(store_of(t, "respirometry"), readings, windows, chambers, [f"{t.folder}/events.parquet"],
                               "user_id", "ts", "event_id", "value", "temp", ["block", "light"], "light", ["unit"], "body_ml", "mass",
                               skip=3, thin=2)
    return made.select("unit", "metric", F.round("rate_corr", 4).alias("rate_corr"), F.round("rate_uncorr", 4).alias("rate_uncorr"),
                       F.round("temp", 5).alias("temp"))
