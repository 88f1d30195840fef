"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import verbs
from ..plans.local_regression import ranked_local_regression
from ..sources import tables as S
from .local_sql import ranked_local_regression_sql
from .registry import query


@query("J1_natural_left", """
    SELECT o_orderkey, k, o_totalprice, c_mktsegment, c_acctbal FROM
      (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS k, o_totalprice FROM orders)
    LEFT JOIN (SELECT CASE WHEN c_custkey = 0 THEN NULL ELSE c_custkey END AS k2, c_mktsegment, c_acctbal FROM customer)
      ON k IS NOT DISTINCT FROM k2""")
def j1(t):
    o = t.orders.select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey")).alias("k"), "o_totalprice")
    c = t.customer.select(F.when(F.col("c_custkey") != 0, F.col("c_custkey")).alias("k"), "c_mktsegment", "c_acctbal")
    return J.natural_join(o, c, "left")


@query("J2_natural_right", """
    SELECT c_custkey AS custkey, c_name, o_orderkey FROM customer RIGHT JOIN
      (SELECT o_custkey, o_orderkey FROM orders) ON c_custkey = o_custkey""")
def j2(t):
    c = t.customer.select(F.col("c_custkey").alias("custkey"), "c_name")
    o = t.orders.select(F.col("o_custkey").alias("custkey"), "o_orderkey")
    return J.natural_join(c, o, "right")


@query("J3_natural_full", """
    SELECT nation, n_suppliers, n_customers FROM
      (SELECT s_nationkey AS nation, count(*) AS n_suppliers FROM supplier WHERE s_acctbal > 3000 GROUP BY 1)
    FULL JOIN (SELECT c_nationkey AS nation, count(*) AS n_customers FROM customer WHERE c_acctbal < 0 GROUP BY 1)
    USING (nation)""")
def j3(t):
    s = t.supplier.filter(F.col("s_acctbal") > 3000).groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("n_suppliers"))
    c = t.customer.filter(F.col("c_acctbal") < 0).groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("n_customers"))
    return J.natural_join(s, c, "full")


@query("J4_keyed_right", """
    SELECT n_nationkey AS nationkey, s_name AS name_supplier, n_name AS name_nation, s_acctbal, n_regionkey
    FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey""")
def j4(t):
    s = t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), "s_acctbal")
    n = t.nation.select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"), "n_regionkey")
    return J.natural_join(s, n, "right", ["nationkey"], ("_supplier", "_nation"))


@query("J5_anti", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN
      (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 3000000)""")
def j5(t):
    big = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).filter("s > 3000000").drop("s")
    return J.anti_join(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), big)


@query("J5_anti_of_itself", "SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 200000)")
def j5_self(t):
    reject = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 200000)
    return verbs.keep_unless(t.orders, reject).select("o_orderkey", "o_totalprice")


@query("J6_semi", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j6(t):
    used = t.lineitem.filter(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("p_partkey"))
    return J.semi_join(t.part.select("p_partkey", "p_name"), used)


def user_windows(t, first_days, last_days=None):
    """Per-user window from the user's own first and last reading."""
    ends = t.events.groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    start = F.col("lo") + F.expr(f"INTERVAL {first_days} DAYS")
    stop = (F.col("hi") - F.expr(f"INTERVAL {-last_days} DAYS") if last_days and last_days < 0
            else F.col("lo") + F.expr(f"INTERVAL {last_days} DAYS"))
    return ends.select("user_id", start.alias("start"), stop.alias("stop"))


@query("J7_interval_join", """
    SELECT e.event_id, e.user_id, e.value FROM events e JOIN
      (SELECT user_id, min(ts) + INTERVAL 1 DAY AS lo, min(ts) + INTERVAL 5 DAY AS hi FROM events GROUP BY 1) w
    ON e.user_id = w.user_id AND e.ts BETWEEN w.lo AND w.hi""")
def j7(t):
    readings = t.events.select("event_id", "user_id", "ts", "value")
    return J.interval_join(readings, user_windows(t, 1, 5), ["user_id"], "ts", many=True).select("event_id", "user_id", "value")


# Invented: a night, a day, a week's end, and one outage of every type that is still open.
OUTAGES = (
    ("click", "2024-01-09 22:00:00", "2024-01-10 04:00:00"),
    ("click", "2024-01-13 00:00:00", "2024-01-14 23:59:59"),
    ("view", "2024-01-17 00:00:00", "2024-01-17 23:59:59"),
    (None, "2024-01-27 12:00:00", None),
)


def outages(t):
    w = S.literal_table(t.spark, OUTAGES, "event_type string, start string, stop string")
    return w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


def outages_sql() -> str:
    """Condition on events e: no outage covers the row; an open end has no bound."""
    def literal(value, kind=""):
        return "NULL" if value is None else f"{kind}'{value}'"
    rows = ", ".join(f"({literal(k)}, CAST({literal(lo)} AS TIMESTAMP), CAST({literal(hi)} AS TIMESTAMP))" for k, lo, hi in OUTAGES)
    return f"""NOT EXISTS (SELECT 1 FROM (VALUES {rows}) w(k, lo, hi)
      WHERE (w.lo IS NULL OR e.ts >= w.lo) AND (w.hi IS NULL OR e.ts <= w.hi) AND (w.k IS NULL OR w.k = e.event_type))"""


@query("J8_exclusion_windows", f"SELECT event_id, event_type, ts FROM events e WHERE {outages_sql()}")
def j8(t):
    return J.exclude_windows(t.events.select("event_id", "event_type", "ts"), outages(t), "event_type", "ts")


@query("J9_instant_lookup", """
    SELECT user_id, ts, event_id, value FROM events JOIN (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)
    USING (user_id, ts)""")
def j9(t):
    last = t.events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    return J.lookup_at(t.events.select("user_id", "ts", "event_id", "value"), last, ["user_id"], "ts", many=True)


@query("J10_align_series", """
    SELECT day, hour, clicks, views FROM
      (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL)
    FULL JOIN (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY ALL)
    USING (day, hour)""")
def j10(t):
    def per_hour(kind, name):
        return (t.events.filter(F.col("event_type") == kind)
                .groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias(name)))
    return J.align(per_hour("click", "clicks"), per_hour("view", "views"), ["day", "hour"])


FIT_COLUMNS = """file AS user_id, start_row, stop_row, round(intercept, 5) AS intercept, round(slope, 7) AS slope,
    round(score, 9) AS score"""


def rounded_fit(df):
    return df.withColumns({"intercept": F.round("intercept", 5), "slope": F.round("slope", 7), "score": F.round("score", 9)})


@query("J11_window_search", f"SELECT {FIT_COLUMNS} FROM (" + ranked_local_regression_sql("""
    (SELECT user_id AS file, CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE) AS x, value AS y FROM
      (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL))""") + ")")
def j11(t):
    """All windows of each user's daily mean series, searched for the straightest."""
    series = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    series = series.withColumn("x", F.unix_date("day"))
    return rounded_fit(ranked_local_regression(series, "user_id", "x", "value", 0.5))
