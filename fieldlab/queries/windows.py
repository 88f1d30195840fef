"""Ordered operators over series and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import ordered as W
from ..operators.joins import attach
from .registry import query

SERIES = ("event_id", "user_id", "ts", "value")
BY_TIME = ["ts", "event_id"]


@query("W1_row_number", """
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events""")
def w1(t):
    return W.numbered(t.events.select("event_id", "user_id", "ts"), ["user_id"], BY_TIME).select("event_id", "user_id", "n")


@query("W2_skip_first", """
    SELECT event_id, user_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3""")
def w2(t):
    return W.skip_first(t.events.select("event_id", "user_id", "ts"), ["user_id"], BY_TIME, 3).select("event_id", "user_id")


@query("W3_every_kth", """
    SELECT event_id, user_id, n FROM
      (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    WHERE n % 5 = 0""")
def w3(t):
    return W.every_kth(t.events.select("event_id", "user_id", "ts"), ["user_id"], BY_TIME, 5).select("event_id", "user_id", "n")


@query("W4_running_total", """
    SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS UNBOUNDED PRECEDING), 4) AS running FROM events""")
def w4(t):
    r = W.numbered(t.events.select(*SERIES), ["user_id"], BY_TIME, running="value")
    return r.select("event_id", "user_id", F.round("running", 4).alias("running"))


@query("W5_first_last", """
    SELECT user_id, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
           count(*) AS n FROM events GROUP BY 1""")
def w5(t):
    return W.first_last(t.events, ["user_id"], BY_TIME, "value")


@query("W6_group_value_on_rows", """
    SELECT l_orderkey, l_linenumber, l_partkey,
           round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 7) AS share FROM lineitem""")
def w6(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    r = A.with_group_value(rows, ["l_orderkey"], many=True, total=F.sum("l_extendedprice"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / F.col("total"), 7).alias("share"))


@query("W7_top_k", """
    SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank
    FROM part QUALIFY rank <= 3""")
def w7(t):
    return W.top_k(t.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"],
                   [F.desc("p_retailprice"), F.col("p_partkey")], 3)


@query("W8_nth_record", """
    SELECT o_custkey, max(o_totalprice) FILTER (rn = 1) AS record_1, max(o_totalprice) FILTER (rn = 2) AS record_2 FROM
      (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn <= 2 GROUP BY 1""")
def w8(t):
    return W.nth_record(t.orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice", (1, 2))


@query("W9_pair_numbers", """
    SELECT o_orderkey, o_orderstatus, o_orderpriority,
           dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS pair_no FROM orders""")
def w9(t):
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return attach(o, W.pair_numbers(o, ["o_orderstatus"], ["o_orderpriority"]), ["o_orderstatus", "o_orderpriority"])
