"""Sources, projection, filters, set operations, sorts and scalar functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import joins, verbs
from ..sources import tables as S
from .registry import TABLES, query

# --- sources and sinks -----------------------------------------------------


@query("S1_table_scan", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def s1(t):
    counts = [getattr(t, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
              for n in TABLES]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("S1_csv_scan", """
    SELECT s_nationkey, count(*) AS n, count(s_acctbal) AS known, round(sum(s_acctbal), 2) AS total
    FROM supplier GROUP BY s_nationkey""")
def s1_csv(t):
    path = S.stage_path(t.spark, "supplier-csv")
    t.supplier.write.option("header", True).option("nullValue", "NA").csv(path)
    back = S.read_csv(t.spark, path, t.supplier.schema)
    return back.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count("s_acctbal").alias("known"),
                                           F.round(F.sum("s_acctbal"), 2).alias("total"))


@query("S2_many_file_scan", """
    SELECT 'customer.parquet' AS file_id, count(*) AS n FROM customer
    UNION ALL SELECT 'nation.parquet', count(*) FROM nation
    UNION ALL SELECT 'supplier.parquet', count(*) FROM supplier""")
def s2(t):
    paths = [f"{t.folder}/{n}.parquet" for n in ("customer", "nation", "supplier")]
    tree = S.read_tree(t.spark, paths, T.StructType([]), fmt="parquet")
    return tree.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


@query("S2_tree_scan", """
    SELECT event_type AS folder, CAST(user_id % 3 AS INTEGER) AS subfolder, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY ALL""")
def s2_tree(t):
    """A tree of part files two folders deep, listed and read in one scan; each row knows its file."""
    base = S.stage_path(t.spark, "event-tree")
    rows = t.events.select("event_id", "value", "event_type", (F.col("user_id") % 3).cast("int").alias("part"))
    for side, place in enumerate(("north", "south")):  # plain folders, not partitions of one table
        half = rows.filter(F.col("event_id") % 2 == side)
        half.write.partitionBy("event_type", "part").parquet(f"{base}/{place}/deep")
    tree = S.read_tree(t.spark, base, "event_id long, value double", fmt="parquet")
    named = tree.select("value", F.regexp_extract("file_path", "event_type=([^/]*)/", 1).alias("folder"),
                        F.regexp_extract("file_path", r"part=(\d+)/", 1).cast("int").alias("subfolder"))
    return named.groupBy("folder", "subfolder").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("S3_preamble_scan", """
    SELECT event_type AS channel, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type""")
def s3(t):
    path = S.stage_path(t.spark, "probe-logs")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy H:mm:ss")
    t.events.select(F.split(stamp, " ")[0].alias("Date"), F.split(stamp, " ")[1].alias("Time"),
                    F.col("event_type").alias("Channel"), F.col("value").alias("Value")
                    ).write.option("header", True).csv(path)
    logs = S.read_log_tree(t.spark, path, ["date", "time", "channel", "value"], "date", "time", ["value"])
    return logs.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Lines above the readings of a logger file, in three wordings; {0}, {1}, {2} are time, value and kind
WORDINGS = ((("Plot title: north site",), '"Date Time, GMT-10:00","Conductance, mS","Kind of reading"', "{0},{1},{2}"),
            (("device 7", "1/5/2024 0:00:00,1.5,click", ""), "#,kind (set),HIGH conductance,DATE and time", "7,{2},{1},{0}"),
            ((), 'kind,"started on date",note,conductance', "{2},{0},,{1}"))
READINGS_A_FILE = 100_000


@query("S3_header_maps", """
    SELECT CAST(event_id % 3 AS INTEGER) AS wording, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total,
           CAST(max(date_trunc('second', ts)) AS TIMESTAMP) AS last_reading
    FROM events GROUP BY ALL""")
def s3_headers(t):
    base = S.stage_path(t.spark, "worded-logs")
    per_wording = F.lit(t.events.count() // (3 * READINGS_A_FILE) + 1)
    e = t.events.select((F.col("event_id") % 3).cast("int").alias("w"), F.floor(F.col("event_id") / 3).alias("k"),
                        F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy H:mm:ss").alias("0"), F.col("value").alias("1"), F.col("event_type").alias("2"))

    def line(pattern):
        parts = re.split(r"\{(\d)\}", pattern)
        return F.concat(*[F.col(x).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])
    body = F.when(F.col("w") == 0, line(WORDINGS[0][2])).when(F.col("w") == 1, line(WORDINGS[1][2])).otherwise(line(WORDINGS[2][2]))
    files = e.select(F.col("w"), F.pmod("k", per_wording).alias("f"), F.lit(1 << 20).alias("place"), body.alias("line"))
    heads = S.literal_table(t.spark, [(w, n, x) for w, (above, header, _) in enumerate(WORDINGS) for n, x in enumerate([*above, header])],
                            "w int, place int, line string")
    heads = files.select("w", "f").distinct().join(F.broadcast(heads), "w").select("w", "f", "place", "line")
    (files.union(heads).repartition("w", "f").sortWithinPartitions("w", "f", "place").select("line", "w", "f")
     .write.partitionBy("w", "f").text(base))
    logs = S.read_header_maps(t.spark, base, {"date": "date", "value": "conductance", "kind": "kind"})
    return (logs.groupBy(F.regexp_extract("file_path", r"w=(\d)", 1).cast("int").alias("wording"), "kind")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"),
                 F.max(C.parse_time("date")).alias("last_reading")))


@query("S4_logger_folder", """
    SELECT CAST(user_id % 4 AS VARCHAR) AS logger_id, count(*) AS n, round(sum(value), 4) AS total,
           CAST(max(date_trunc('second', ts)) AS TIMESTAMP) AS last_reading
    FROM events GROUP BY ALL""")
def s4(t):
    base = S.stage_path(t.spark, "loggers")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy H:mm:ss").alias("stamp")
    (t.events.select(stamp, "value", (F.col("user_id") % 4).alias("logger"))
     .write.partitionBy("logger").option("header", True).csv(base))
    logs = S.read_log_tree(t.spark, base, ["stamp", "value"], "stamp", numbers=["value"])
    tidy = S.logger_series(logs, {"value": "value"}, r"logger=(\d+)", "file_path")
    return tidy.groupBy("logger_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"),
                                         F.max("date").alias("last_reading"))


STATUS = (("F", "filled"), ("O", "open"), ("P", "pending"))


@query("S5_literal_table", """
    SELECT v.label, count(*) AS n FROM orders
    JOIN (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'pending')) AS v(o_orderstatus, label)
    USING (o_orderstatus) GROUP BY v.label""")
def s5(t):
    lit = S.literal_table(t.spark, STATUS, "o_orderstatus string, label string")
    return joins.natural_join(t.orders, lit, "inner").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("S6_stage_round_trip", """
    SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type""")
def s6(t):
    back = S.write_stage(t.events.select("event_id", "user_id", "event_type"),
                         S.stage_path(t.spark, "events"), ["event_type"])
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


MANIFEST = (
    ("click", "2024-01-03 00:00:00", True, "2024-01-20 12:00:00", False, None),
    ("view", None, None, "2024-01-15 00:00:00", True, None),
    ("error", "2024-01-02 06:00:00", False, None, None, 40.0),
    ("signup", None, None, None, None, None),
)


@query("S7_manifest_selection", """
    WITH manifest(event_type, lo, lo_in, hi, hi_in, cap) AS (VALUES
        ('click', TIMESTAMP '2024-01-03', true, TIMESTAMP '2024-01-20 12:00:00', false, NULL),
        ('view', NULL, NULL, TIMESTAMP '2024-01-15', true, NULL),
        ('error', TIMESTAMP '2024-01-02 06:00:00', false, NULL, NULL, 40.0),
        ('signup', NULL, NULL, NULL, NULL, NULL))
    SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(ts) AS first_ts, max(ts) AS last_ts
    FROM events JOIN manifest USING (event_type)
    WHERE (lo IS NULL OR ts > lo OR (lo_in AND ts = lo)) AND (hi IS NULL OR ts < hi OR (hi_in AND ts = hi))
      AND (cap IS NULL OR value <= cap)
    GROUP BY event_type""")
def s7(t):
    m = S.literal_table(t.spark, MANIFEST, "event_type string, keep_from string, from_incl boolean, "
                                           "keep_to string, to_incl boolean, max_value double")
    m = m.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("keep_from", "keep_to")})
    kept = S.select_files(t.events, m, "event_type", "ts", "value")
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"),
                                          F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# --- projection and filters ------------------------------------------------

@query("P1_select", "SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_extendedprice, l_discount, l_tax "
                    "FROM lineitem")
def p1(t):
    money = verbs.column_range(t.lineitem, "l_extendedprice", "l_tax")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), *money)


@query("P2_rename_relocate", "SELECT o_orderkey AS order_id, o_orderdate AS placed, o_custkey AS customer_id, "
                             "o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def p2(t):
    named = t.orders.withColumnsRenamed({"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderdate": "placed"})
    return verbs.relocate(named, ["placed"], after="order_id")


@query("P3_filter", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE (l_returnflag = 'R' AND l_quantity < 10) OR (l_returnflag <> 'N' AND l_discount > 0.07)""")
def p3(t):
    f, q, d = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_discount")
    return t.lineitem.filter(((f == "R") & (q < 10)) | ((f != "N") & (d > 0.07))).select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("P4_time_between", """
    SELECT event_id, ts FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 06:00:00'""")
def p4(t):
    return t.events.filter(F.col("ts").between(F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"),
                                               F.lit("2024-01-12 06:00:00").cast("timestamp_ntz"))
                           ).select("event_id", "ts")


@query("P5_time_trims", """
    SELECT event_id, event_type, ts FROM events
    WHERE (event_type = 'click' AND ts >= TIMESTAMP '2024-01-10')
       OR (event_type = 'view' AND ts > TIMESTAMP '2024-01-20')
       OR (event_type = 'error' AND ts < TIMESTAMP '2024-01-04')""")
def p5(t):
    def at(s):
        return F.lit(s).cast("timestamp_ntz")
    e, ts = F.col("event_type"), F.col("ts")
    return t.events.filter(((e == "click") & (ts >= at("2024-01-10"))) | ((e == "view") & (ts > at("2024-01-20")))
                           | ((e == "error") & (ts < at("2024-01-04")))).select("event_id", "event_type", "ts")


@query("P6_in_list", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#3', 'Brand#12', 'Brand#25')")
def p6(t):
    return t.part.filter(F.col("p_brand").isin("Brand#3", "Brand#12", "Brand#25")).select("p_partkey", "p_brand")


@query("P7_drop_null", """
    SELECT o_orderkey, o_custkey, c_acctbal FROM orders
    LEFT JOIN (SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey
    WHERE c_acctbal IS NOT NULL""")
def p7(t):
    good = t.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    joined = joins.natural_join(t.orders.select("o_orderkey", "o_custkey"), good, "left")
    return verbs.drop_null(joined, "c_acctbal").select("o_orderkey", "o_custkey", "c_acctbal")


@query("P8_recode", """
    SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'first' WHEN 'NATION_2' THEN 'second'
                             WHEN 'NATION_3' THEN 'third' ELSE n_name END AS label FROM nation""")
def p8(t):
    names = {"NATION_1": "first", "NATION_2": "second", "NATION_3": "third"}
    return t.nation.select("n_nationkey", C.recode("n_name", names).alias("label"))


@query("P9_buckets", """
    SELECT CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice < 100000 THEN 'low'
                WHEN o_totalprice < 300000 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n
    FROM orders GROUP BY 1""")
def p9(t):
    b = C.ladder("o_totalprice", [(100000, "low"), (300000, "middle")], "high")
    return t.orders.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


PRICE_PATCHES = {3: 112.5, 17: 480.75, 29: 0.0}


@query("P10_patch", f"""
    SELECT p_partkey, CASE p_partkey {" ".join(f"WHEN {k} THEN {v}" for k, v in PRICE_PATCHES.items())} ELSE p_retailprice END AS price
    FROM part""")
def p10(t):
    return t.part.select("p_partkey", C.patch_value("p_partkey", "p_retailprice", PRICE_PATCHES).alias("price"))


@query("P10_patch_table", """
    SELECT p_partkey, p_brand, coalesce(CASE WHEN n > 90 THEN 0.0 END, p_retailprice) AS p_retailprice FROM part
    LEFT JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) USING (p_brand)""")
def p10_table(t):
    common = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).filter("n > 90")
    return joins.patch_from(t.part.select("p_partkey", "p_brand", "p_retailprice"),
                            common.select("p_brand", F.lit(0.0).alias("p_retailprice")), ["p_brand"], "p_retailprice")


@query("P11_clamp_and_flip", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS clamped, -c_acctbal AS flipped FROM customer""")
def p11(t):
    return t.customer.select("c_custkey", C.clamp_zero("c_acctbal").alias("clamped"), (-F.col("c_acctbal")).alias("flipped"))


@query("P12_across", """
    SELECT s_suppkey, s_name, s_nationkey, round(s_acctbal / 7, 3) AS s_acctbal FROM supplier""")
def p12(t):
    return verbs.across(t.supplier, lambda c: F.round(c / 7, 3), of_type=T.DoubleType)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("P13_ordered_factor", """
    SELECT o_orderpriority, list_position(['5-LOW', '3-MEDIUM', '1-URGENT'], o_orderpriority) AS level, count(*) AS n
    FROM orders WHERE o_orderpriority IN ('5-LOW', '3-MEDIUM', '1-URGENT') GROUP BY ALL""")
def p13(t):
    levels = ["5-LOW", "3-MEDIUM", "1-URGENT"]
    known = t.orders.withColumn("level", C.ordinal("o_orderpriority", levels)).filter(F.col("level").isNotNull())
    return known.groupBy("o_orderpriority", "level").agg(F.count(F.lit(1)).alias("n"))


@query("P14_unit_repair", """
    SELECT event_id, CASE WHEN value > 50 THEN (value - 32.0) * 5.0 / 9.0 ELSE value END AS celsius FROM events""")
def p14(t):
    return t.events.select("event_id", C.celsius("value").alias("celsius"))


@query("P15_text_exclusion", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'ring')")
def p15(t):
    return verbs.keep_unless(t.part, F.col("p_name").contains("ring")).select("p_partkey", "p_name")


# --- sorts and set operations ----------------------------------------------

@query("O1_sort", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def o1(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(
        "o_custkey", F.desc("o_totalprice"), "o_orderkey")


@query("O2_sort_by_levels", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def o2(t):
    n = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return verbs.order_by_levels(n, "o_orderpriority", PRIORITIES[::-1])


@query("O3_head_after_sort", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 8")
def o3(t):
    return t.part.select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(8)


@query("U1_bind_rows", """
    SELECT s_nationkey AS nation, s_acctbal AS balance, 'supplier' AS kind FROM supplier
    UNION ALL SELECT c_nationkey, c_acctbal, 'customer' FROM customer""")
def u1(t):
    s = t.supplier.select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"),
                          F.lit("supplier").alias("kind"))
    c = t.customer.select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"),
                          F.col("c_nationkey").alias("nation"))
    return verbs.stack(s, c)


@query("U3_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u3(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("U4_except", """
    SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL
    SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 250000""")
def u4(t):
    o = t.orders.select("o_orderkey", "o_orderstatus")
    return o.exceptAll(t.orders.filter(F.col("o_totalprice") > 250000).select("o_orderkey", "o_orderstatus"))


# --- scalar functions ------------------------------------------------------

@query("F1_unite", """
    SELECT p_partkey, p_type || '_' || p_brand AS both_names, coalesce(nullif(p_type, 'PROMO'), 'NA') || '-' || p_size AS shown,
           concat_ws('-', nullif(p_type, 'PROMO'), p_size) AS skipped FROM part""")
def f1(t):
    hidden = F.nullif("p_type", F.lit("PROMO"))
    return t.part.select("p_partkey", C.unite(["p_type", "p_brand"]).alias("both_names"),
                         C.unite([hidden, "p_size"], "-").alias("shown"),
                         C.unite([hidden, "p_size"], "-", skip_null=True).alias("skipped"))


@query("F2_separate", """
    SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level, split_part(o_orderpriority, '-', 2) AS word,
           CAST(NULL AS VARCHAR) AS missing FROM orders""")
def f2(t):
    return t.orders.withColumns(C.separate("o_orderpriority", "-", ["level", "word", "missing"])).select(
        "o_orderkey", "level", "word", "missing")


@query("F3_substring", """
    SELECT p_partkey, contains(p_name, 'bolt') AS has_bolt, replace(p_name, 'red', 'RED') AS replaced,
           CASE WHEN suffix(p_name, 'ring') THEN left(p_name, length(p_name) - 4) ELSE p_name END AS stripped
    FROM part""")
def f3(t):
    return t.part.select("p_partkey", F.col("p_name").contains("bolt").alias("has_bolt"),
                         F.replace("p_name", F.lit("red"), F.lit("RED")).alias("replaced"),
                         C.strip_suffix("p_name", "ring").alias("stripped"))


@query("F4_basename", "SELECT page_id, split_part(url, '/', -1) AS base FROM pages")
def f4(t):
    return t.pages.select("page_id", C.basename("url").alias("base"))


@query("F5_display", """
    SELECT p_partkey, coalesce(CAST(CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS VARCHAR), '-') AS size_text,
           printf('%.2f', p_retailprice) AS price_text FROM part""")
def f5(t):
    return t.part.select("p_partkey", C.dash_if_null(F.when(F.col("p_size") <= 40, F.col("p_size"))).alias("size_text"),
                         F.format_string("%.2f", "p_retailprice").alias("price_text"))


@query("F5s_scientific", """
    SELECT c_custkey, CASE WHEN c_acctbal > 1000 THEN format('{:.1e}', c_acctbal) ELSE CAST(c_acctbal AS VARCHAR) END AS shown FROM customer""")
def f5s_scientific(t):
    return t.customer.select("c_custkey", C.scientific_if_large("c_acctbal").alias("shown"))


@query("D1_parse_time", """
    SELECT event_id, date_trunc('second', ts) AS parsed, CAST(ts AS DATE) AS parsed_day, CAST(NULL AS TIMESTAMP) AS bad
    FROM events""")
def d1(t):
    zoned = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id", C.parse_time(F.date_format(zoned, "M/d/yyyy H:mm:ss")).alias("parsed"),
        C.parse_date(F.date_format(zoned, "M/d/yyyy")).alias("parsed_day"),
        C.parse_time(F.concat("event_type", F.lit(" at noon"))).alias("bad"))


@query("D2_day_of_year", """
    SELECT o_orderkey, dayofyear(o_orderdate) AS doy,
           date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS days_to_2000 FROM orders""")
def d2(t):
    return t.orders.select("o_orderkey", F.dayofyear("o_orderdate").alias("doy"),
                           F.datediff(F.lit("2000-01-01").cast("date"), F.to_date("o_orderdate")).alias("days_to_2000"))


@query("D3_elapsed", """
    SELECT user_id, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 6) AS sec,
           round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 6) AS hours FROM events GROUP BY user_id""")
def d3(t):
    ends = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("user_id", F.round(C.elapsed("a", "b"), 6).alias("sec"),
                       F.round(C.elapsed("a", "b", "h"), 6).alias("hours"))


@query("D4_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def d4(t):
    return t.events.groupBy(C.day("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("M1_arithmetic", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount) * 0.001, 7) AS net_k FROM lineitem""")
def m1(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 0.001, 7).alias("net_k"))


@query("M2_signif", """
    SELECT o_orderkey, round(o_totalprice / 1000, 0) AS thousands,
           round(o_totalprice * pow(10, 2 - floor(log10(o_totalprice)))) / pow(10, 2 - floor(log10(o_totalprice))) AS sig3
    FROM orders""")
def m2(t):
    return t.orders.select("o_orderkey", F.round(F.col("o_totalprice") / 1000, 0).alias("thousands"),
                           C.signif("o_totalprice", 3).alias("sig3"))


@query("M3_null_tests", """
    SELECT c_custkey, n IS NULL AS none, coalesce(n, 0) AS orders_over FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey""")
def m3(t):
    big = (t.orders.filter(F.col("o_totalprice") > 400000).groupBy(F.col("o_custkey").alias("c_custkey"))
           .agg(F.count(F.lit(1)).alias("n")))
    return joins.natural_join(t.customer.select("c_custkey"), big, "left").select(
        "c_custkey", F.col("n").isNull().alias("none"), F.coalesce("n", F.lit(0)).alias("orders_over"))


@query("M4_percent_change", """
    SELECT user_id, round(b - a, 6) AS change, round((b - a) / nullif(a, 0), 6) AS relative,
           round(100 * (b - a) / nullif(a, 0), 6) AS pct
    FROM (SELECT user_id, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events GROUP BY 1)""")
def m4(t):
    from ..operators.ordered import first_last
    e = first_last(t.events, ["user_id"], ["ts", "event_id"], "value")
    a, b = F.col("first_value"), F.col("last_value")
    return e.select("user_id", F.round(b - a, 6).alias("change"), F.round(C.ratio(b - a, a), 6).alias("relative"),
                    F.round(C.percent_change(b, a), 6).alias("pct"))
