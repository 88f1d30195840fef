"""Grouped summaries and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import quantiles, reshape
from .registry import query


@query("A1_mean_se", """
    SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd,
           round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 8) AS se FROM lineitem GROUP BY 1""")
def a1(t):
    s = A.mean_se(t.lineitem, ["l_returnflag"], "l_quantity")
    return s.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"),
                    F.round("se", 8).alias("se"))


@query("A2_min_max_range", """
    SELECT event_type, min(value) AS lo, max(value) AS hi, round(max(value) - min(value), 6) AS spread
    FROM events GROUP BY 1""")
def a2(t):
    s = A.spread(t.events, ["event_type"], {"value": "v"})
    return s.select("event_type", F.col("min_v").alias("lo"), F.col("max_v").alias("hi"),
                    F.round("range_v", 6).alias("spread"))


@query("A3_median", "SELECT s_nationkey, round(quantile_cont(s_acctbal, 0.5), 6) AS median FROM supplier GROUP BY 1")
def a3(t):
    m = quantiles.medians(t.supplier, ["s_nationkey"], "s_acctbal")
    return m.select("s_nationkey", F.round("median", 6).alias("median"))


@query("A3_median_skewed_groups", """
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.1), 6) AS p10
    FROM events GROUP BY 1""")
def a3_events(t):
    q = quantiles.exact_quantiles(t.events, ["event_type"], "value", {"median": 0.5, "p10": 0.1})
    return q.select("event_type", F.round("median", 6).alias("median"), F.round("p10", 6).alias("p10"))


@query("A4_strict_sum", """
    SELECT o_custkey, CASE WHEN count(*) = count(v) THEN round(sum(v), 2) END AS strict_total, round(sum(v), 2) AS total
    FROM (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS v FROM orders)
    GROUP BY 1""")
def a4(t):
    v = t.orders.select("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("v"))
    return v.groupBy("o_custkey").agg(F.round(A.strict(F.sum, "v"), 2).alias("strict_total"),
                                      F.round(F.sum("v"), 2).alias("total"))


@query("A5_replicate_mean", """
    SELECT user_id, event_type, round(avg(value), 7) AS mean_value FROM events GROUP BY ALL""")
def a5(t):
    return t.events.groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 7).alias("mean_value"))


@query("A6_combine_parts", """
    SELECT l_orderkey, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price
    FROM lineitem GROUP BY 1""")
def a6(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"),
                                                F.round(F.sum("l_extendedprice"), 2).alias("price"))


PART_NAMES = {"1": "first half", "2": "first half", "3": "first half"}


@query("A6_alias_merge", f"""
    SELECT l_orderkey, CASE part {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART_NAMES.items())} ELSE part END AS part,
           round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price
    FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS part FROM lineitem) GROUP BY ALL""")
def a6_alias(t):
    rows = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("string").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    merged = A.combine_parts(rows, ["l_orderkey"], "part", PART_NAMES, ["quantity", "price"])
    return merged.select("l_orderkey", "part", *[F.round(c, 2).alias(c) for c in ("quantity", "price")])


@query("A7_unpaired", "SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) = 1")
def a7(t):
    return A.sole_or_repeated(t.orders, ["o_custkey", "o_orderstatus"])


@query("A7_duplicated", """
    SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def a7_twice(t):
    return A.sole_or_repeated(t.lineitem, ["l_orderkey", "l_linenumber"], repeated=True)


@query("A8_daily_summary", """
    SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 7) AS mean_v, max(value) AS max_v, min(value) AS min_v,
           round(max(value) - min(value), 6) AS range_v FROM events GROUP BY ALL""")
def a8(t):
    d = A.daily(t.events, ["event_type"], "ts", {"value": "v"})
    return d.withColumns({"mean_v": F.round("mean_v", 7), "range_v": F.round("range_v", 6)})


@query("A9_share", """
    SELECT l_returnflag, p_brand, round(100 * q / sum(q) OVER (PARTITION BY l_returnflag), 6) AS cover FROM
      (SELECT l_returnflag, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)""")
def a9(t):
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "p_brand", "l_quantity")
    return A.share_of_total(items, ["l_returnflag"], "p_brand", "l_quantity").select(
        "l_returnflag", "p_brand", F.round("cover", 6).alias("cover"))


@query("A10_level_difference", """
    SELECT day, round(a, 7) AS low, round(b, 7) AS high, round(100 * (a - b) / nullif(b, 0), 6) AS difference FROM
      (SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'click') AS a,
              avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)""")
def a10(t):
    days = t.events.withColumn("day", F.to_date("ts"))
    d = A.level_difference(days, ["day"], "event_type", "value", "click", "view")
    return d.select("day", F.round("low", 7).alias("low"), F.round("high", 7).alias("high"),
                    F.round("difference", 6).alias("difference"))


@query("A11_baseline", """
    SELECT l_suppkey, l_returnflag, round(avg(l_discount - l_tax), 8) AS blank_rate FROM lineitem
    WHERE l_linestatus = 'F' GROUP BY ALL""")
def a11(t):
    rows = t.lineitem.withColumn("rate", F.col("l_discount") - F.col("l_tax"))
    b = A.baseline(rows, ["l_suppkey", "l_returnflag"], F.col("l_linestatus") == "F", "rate")
    return b.withColumn("blank_rate", F.round("blank_rate", 8))


@query("A12_component_sum", """
    SELECT user_id, event_type, round(sum(value), 4) AS total, round(sum(2 * value), 4) AS twice,
           round(avg(value), 7) AS mean_value, 'GP' AS metric FROM events GROUP BY user_id, event_type""")
def a12(t):
    return t.events.groupBy("user_id", "event_type").agg(
        F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(2 * F.col("value")), 4).alias("twice"),
        F.round(F.avg("value"), 7).alias("mean_value")).withColumn("metric", F.lit("GP"))


@query("A13_whole_table", """
    SELECT round(avg(l_quantity), 7) AS mean, round(stddev_samp(l_quantity), 7) AS sd,
           round(stddev_samp(l_quantity) / sqrt(count(*)), 9) AS se, count(*) AS n FROM lineitem""")
def a13(t):
    return t.lineitem.agg(F.round(F.avg("l_quantity"), 7).alias("mean"), F.round(F.stddev_samp("l_quantity"), 7).alias("sd"),
                          F.round(A.std_error("l_quantity"), 9).alias("se"), F.count(F.lit(1)).alias("n"))


LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("R1_widen_counts", """
    SELECT o_orderstatus, """ + ", ".join(f"""count(*) FILTER (o_orderpriority = '{p}') AS "{p}" """ for p in LEVELS)
       + " FROM orders GROUP BY 1")
def r1(t):
    return reshape.counts_wide(t.orders, ["o_orderstatus"], "o_orderpriority", LEVELS).na.fill(0)


@query("R1_widen_values", """
    SELECT o_custkey, round(max(v) FILTER (o_orderstatus = 'F'), 2) AS "F", round(max(v) FILTER (o_orderstatus = 'O'), 2) AS "O",
           round(max(v) FILTER (o_orderstatus = 'P'), 2) AS "P"
    FROM (SELECT o_custkey, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY ALL) GROUP BY 1""")
def r1_values(t):
    v = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return reshape.widen(v, ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "v")


@query("R2_lengthen", """
    SELECT l_orderkey, l_linenumber, parameter, value FROM
      (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_tax FROM lineitem)
    UNPIVOT (value FOR parameter IN (l_quantity, l_extendedprice, l_tax))""")
def r2(t):
    return reshape.lengthen(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"),
                            ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_tax"])
