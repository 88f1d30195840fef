"""Growth, respiration, chemistry and community jobs on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import water
from ..plans import chemistry, community, growth, respiro
from ..sources import tables as S
from .joins import rounded_fit, user_windows
from .local_sql import ranked_local_regression_sql
from .registry import query

# --- water adapter ---------------------------------------------------------

WATER_SQL = """(SELECT *, CAST(30 + event_id % 10 AS DOUBLE) AS sal, CAST(20 + user_id % 12 AS DOUBLE) AS temp,
                -80.0 + value / 10 AS mv, CAST(50 + user_id % 12 AS DOUBLE) AS cond FROM events)"""
T68 = "((temp - 0.0002) / 0.99975)"
DENSITY_SQL = f"""(999.842594 + 6.793952e-2*{T68} - 9.095290e-3*{T68}**2 + 1.001685e-4*{T68}**3 - 1.120083e-6*{T68}**4
    + 6.536332e-9*{T68}**5
    + (8.24493e-1 - 4.0899e-3*{T68} + 7.6438e-5*{T68}**2 - 8.2467e-7*{T68}**3 + 5.3875e-9*{T68}**4)*sal
    + (-5.72466e-3 + 1.0227e-4*{T68} - 1.6546e-6*{T68}**2)*sal**1.5 + 4.8314e-4*sal**2)"""


def water_rows(t) -> DataFrame:
    return t.events.select(
        "event_id", "user_id", "event_type", "ts", "value", (30.0 + F.col("event_id") % 10).alias("sal"),
        (20.0 + F.col("user_id") % 12).alias("temp"), (-80.0 + F.col("value") / 10).alias("mv"),
        (50.0 + F.col("user_id") % 12).alias("cond"))


@query("C1_seawater_density", f"SELECT event_id, round({DENSITY_SQL} * 0.001, 9) AS sw_dens FROM {WATER_SQL}")
def c1(t):
    return growth.with_water_density(water_rows(t), "sal", "temp").select("event_id", F.round("sw_dens", 9).alias("sw_dens"))


@query("C2_dry_weight", f"""
    SELECT event_id, round(value / (1 - d / CASE WHEN event_type = 'view' THEN 2.71 ELSE 2.93 END), 7) AS dry_weight
    FROM (SELECT *, {DENSITY_SQL} * 0.001 AS d FROM {WATER_SQL}) WHERE event_type NOT IN ('error', 'signup')""")
def c2(t):
    body = F.when(F.col("event_type") == "view", 2.71).otherwise(2.93)
    d = growth.dry_weights(water_rows(t), "event_type", "value", "sal", "temp", body,
                           F.col("event_type").isin("error", "signup"))
    return d.select("event_id", F.round("dry_weight", 7).alias("dry_weight"))


@query("C3_standard_drift", """
    SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'pre' ELSE 'post' END AS phase, event_type AS standard,
           round(avg(value), 7) AS mean_weight, round(stddev_samp(value) / sqrt(count(value)), 8) AS se_weight
    FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL""")
def c3(t):
    phase = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "pre").otherwise("post")
    rows = t.events.filter(F.col("event_type").isin("error", "signup")).select(
        phase.alias("phase"), F.col("event_type").alias("standard"), "value")
    return growth.standard_drift(rows, "phase", "standard", "value").withColumns(
        {"mean_weight": F.round("mean_weight", 7), "se_weight": F.round("se_weight", 8)})


# --- growth adapter --------------------------------------------------------

PREPOST_SQL = """(SELECT o_custkey AS organism, count(*) AS n_weighings,
       arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS pre, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS post,
       CAST(min(o_orderdate) AS DATE) AS pre_date, CAST(max(o_orderdate) AS DATE) AS post_date
       FROM orders GROUP BY 1)"""
GROWTH_SQL = f"""(SELECT organism, c_mktsegment AS taxon, date_diff('day', pre_date, post_date) AS days, post - pre AS change,
       (post - pre) / pre AS change_per_mass, 100 * (post - pre) / pre AS change_pct,
       (post - pre) / pre / nullif(date_diff('day', pre_date, post_date), 0) * 1000 AS mg_g_day
       FROM {PREPOST_SQL} JOIN customer ON c_custkey = organism WHERE n_weighings > 1)"""


def weighings(t) -> DataFrame:
    """First and last order of each customer as a pre and a post weighing."""
    at = F.struct("o_orderdate", "o_orderkey")
    ends = t.orders.groupBy(F.col("o_custkey").alias("organism")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("o_totalprice", at).alias("w1"), F.max_by("o_totalprice", at).alias("w2"),
        F.to_date(F.min("o_orderdate")).alias("d1"), F.to_date(F.max("o_orderdate")).alias("d2"))
    both = F.array(F.struct(F.lit("pre").alias("phase"), F.col("w1").alias("weight"), F.col("d1").alias("date")),
                   F.struct(F.lit("post").alias("phase"), F.col("w2").alias("weight"), F.col("d2").alias("date")))
    long = ends.select("organism", "n", F.explode(both).alias("w")).select("organism", "n", "w.*")
    long = long.filter((F.col("phase") == "pre") | (F.col("n") > 1)).drop("n")
    taxa = t.customer.select(F.col("c_custkey").alias("organism"), F.col("c_mktsegment").alias("taxon"))
    return long.join(taxa, "organism")


def growth_rows(t) -> DataFrame:
    return growth.growth(weighings(t), ["organism", "taxon"], "phase", "weight", "date")


def rounded_growth(df: DataFrame) -> DataFrame:
    return df.select("organism", "taxon", "days", F.round("change", 4).alias("change"),
                     F.round("change_per_mass", 7).alias("change_per_mass"),
                     F.round("change_pct", 5).alias("change_pct"), F.round("mg_g_day", 6).alias("mg_g_day"))


ROUNDED_GROWTH = """organism, taxon, days, round(change, 4) AS change, round(change_per_mass, 7) AS change_per_mass,
                    round(change_pct, 5) AS change_pct, round(mg_g_day, 6) AS mg_g_day"""


@query("C4_growth", f"SELECT {ROUNDED_GROWTH} FROM {GROWTH_SQL}")
def c4(t):
    return rounded_growth(growth_rows(t))


#: Taxa left out, and the least change in percent that counts as growth and not as breakage
LEFT_OUT = ("BUILDING",)
LEAST_CHANGE = {"AUTOMOBILE": -35.5, "FURNITURE": -62.5, "MACHINERY": -12.25}
CLEAN_SQL = f"""(SELECT * FROM {GROWTH_SQL} WHERE mg_g_day IS NOT NULL AND taxon NOT IN ({", ".join(f"'{x}'" for x in LEFT_OUT)})
    {" ".join(f"AND NOT (taxon = '{k}' AND change_pct < {v})" for k, v in LEAST_CHANGE.items())})"""


def clean_rows(t) -> DataFrame:
    return growth.clean_growth(growth_rows(t), "taxon", "change_pct", "mg_g_day", list(LEFT_OUT), LEAST_CHANGE)


@query("C5_growth_cleaning", f"SELECT {ROUNDED_GROWTH} FROM {CLEAN_SQL}")
def c5(t):
    return rounded_growth(clean_rows(t))


@query("C6_complete_pairs", f"""
    SELECT {ROUNDED_GROWTH} FROM {CLEAN_SQL} c JOIN
      (SELECT organism // 2 AS pair, count(*) AS n FROM {CLEAN_SQL} GROUP BY 1 HAVING count(*) <> 1) p
    ON p.pair = c.organism // 2""")
def c6(t):
    rows = clean_rows(t).withColumn("pair", F.floor(F.col("organism") / 2).cast("long"))
    return rounded_growth(growth.complete_pairs(rows, ["pair"]))


@query("C7_length_change", f"""
    SELECT organism, round((post - pre) / 1000, 5) AS length_change, round(100 * (post - pre) / pre, 5) AS length_pct
    FROM {PREPOST_SQL} WHERE n_weighings > 1""")
def c7_length(t):
    w = weighings(t).withColumn("length", F.col("weight") / 1000)
    c = growth.length_change(w, ["organism"], "phase", "length")
    return c.select("organism", F.round("length_change", 5).alias("length_change"), F.round("length_pct", 5).alias("length_pct"))


@query("C7_volume_change", f"""
    SELECT organism, round(post - pre, 4) AS volume_change, round(100 * (post - pre) / pre, 5) AS volume_pct
    FROM {PREPOST_SQL} WHERE n_weighings > 1""")
def c7_volume(t):
    w = weighings(t).withColumnRenamed("weight", "volume")
    grown = w.filter((F.col("phase") == "pre") | (F.col("organism") % 2 == 0)).select("organism", "phase", "volume")
    chamber = w.filter(F.col("phase") == "post").select("organism", "volume")
    c = growth.volume_change(grown, chamber, ["organism"], "phase", "volume")
    return c.select("organism", F.round("volume_change", 4).alias("volume_change"), F.round("volume_pct", 5).alias("volume_pct"))


@query("C8_surface_area", """
    SELECT o_orderkey, round(CASE o_orderstatus WHEN 'F' THEN 38.6 * o_totalprice / 100000 + 2.46
                             WHEN 'O' THEN 241 * o_totalprice / 100000 - 2.48 END, 8) AS area_cm2 FROM orders""")
def c8(t):
    method = F.when(F.col("o_orderstatus") == "F", "wax").when(F.col("o_orderstatus") == "O", "foil")
    rows = t.orders.select("o_orderkey", method.alias("method"), (F.col("o_totalprice") / 100000).alias("coat"))
    return growth.surface_area(rows, "method", "coat").select("o_orderkey", F.round("area_cm2", 8).alias("area_cm2"))


@query("C9_area_growth", f"""
    SELECT organism, taxon, round(change / nullif(days, 0) / (10 + organism % 50) * 1000, 4) AS mg_cm2_day FROM {GROWTH_SQL}
    WHERE taxon IN ('BUILDING', 'MACHINERY')""")
def c9(t):
    rows = growth_rows(t).withColumn("area", 10 + F.col("organism") % 50)
    g = growth.area_growth(rows, "taxon", ["BUILDING", "MACHINERY"], "change", "days", "area")
    return g.select("organism", "taxon", F.round("mg_cm2_day", 4).alias("mg_cm2_day"))


#: Values put in place of single records
VOLUME_PATCHES, MASS_PATCHES = {"7-1": 31.5}, {"7-2": 1840.25}


def patched_sql(name: str, value: str, patches: dict) -> str:
    return f"CASE {name} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in patches.items())} ELSE {value} END"


@query("C10_assemblage_mass", f"""
    WITH m AS (SELECT l_orderkey, l_orderkey % 2 AS treatment, l_orderkey || '-' || l_linenumber AS member,
               l_quantity AS vol, (l_extendedprice - l_tax) - (l_discount - l_tax) AS mass FROM lineitem),
    masses AS (SELECT l_orderkey, treatment, {patched_sql("member", "total", MASS_PATCHES)} AS mass FROM
               (SELECT l_orderkey, treatment, member, sum(mass) AS total FROM m GROUP BY ALL)),
    v AS (SELECT l_orderkey, sum({patched_sql("member", "vol", VOLUME_PATCHES)}) AS volume FROM m GROUP BY 1)
    SELECT l_orderkey, treatment, round(any_value(volume), 2) AS volume, round(sum(mass), 2) AS mass
    FROM masses JOIN v USING (l_orderkey) GROUP BY ALL""")
def c10(t):
    from ..functions.columns import unite
    rows = t.lineitem.select("l_orderkey", (F.col("l_orderkey") % 2).alias("treatment"),
                             unite(["l_orderkey", "l_linenumber"], "-").alias("member"), F.col("l_quantity").alias("volume"),
                             growth.ash_free_mass("l_tax", "l_extendedprice", "l_discount").alias("mass"))
    a = growth.assemblage_mass(rows.drop("mass"), rows.select("member", "mass"), ["l_orderkey", "treatment"], "member",
                               "volume", "mass", volume_patches=VOLUME_PATCHES, mass_patches=MASS_PATCHES)
    return a.select("l_orderkey", "treatment", F.round("volume", 2).alias("volume"), F.round("mass", 2).alias("mass"))


# --- incubations -----------------------------------------------------------

@query("C11_series_trimming", """
    SELECT e.user_id, count(*) AS n, round(sum(value), 4) AS total FROM events e JOIN
      (SELECT user_id, min(ts) + INTERVAL 1 DAY AS lo, max(ts) - INTERVAL 1 DAY AS hi,
              CASE WHEN user_id % 3 = 0 THEN 60.0 END AS cap FROM events GROUP BY user_id) w
    ON e.user_id = w.user_id WHERE ts > lo AND ts <= hi AND (cap IS NULL OR value <= cap) GROUP BY 1""")
def c11(t):
    manifest = user_windows(t, 1, -1).select(
        "user_id", F.col("start").alias("keep_from"), F.lit(False).alias("from_incl"), F.col("stop").alias("keep_to"),
        F.lit(True).alias("to_incl"), F.when(F.col("user_id") % 3 == 0, 60.0).alias("max_value"))
    kept = S.select_files(t.events.select("user_id", "ts", "value"), manifest, "user_id", "ts", "value", many=True)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


SERIES_SQL = """(SELECT user_id, temp, value, n - 3 AS sec FROM
    (SELECT e.user_id, 20.0 + e.user_id % 12 AS temp, value, row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) AS n FROM events e
     JOIN (SELECT user_id, min(ts) + INTERVAL 1 DAY AS lo, max(ts) - INTERVAL 1 DAY AS hi FROM events GROUP BY 1) w
     ON e.user_id = w.user_id AND ts BETWEEN lo AND hi) WHERE n > 3 AND (n - 3) % 2 = 0)"""


@query("C12_incubation_rates", f"""
    SELECT user_id, start_row, stop_row, round(intercept, 5) AS intercept, round(slope, 7) AS slope, round(score, 9) AS score,
           round(mean_temp, 7) AS mean_temp FROM (""" + ranked_local_regression_sql(
    f"(SELECT user_id AS file, CAST(sec AS DOUBLE) AS x, value AS y FROM {SERIES_SQL})") + f""")
    JOIN (SELECT user_id, avg(temp) AS mean_temp FROM {SERIES_SQL} GROUP BY 1) ON user_id = file""")
def c12(t):
    rows = t.events.select("user_id", "ts", "event_id", "value", (20.0 + F.col("user_id") % 12).alias("temp"))
    fits = respiro.incubation_rates(rows, user_windows(t, 1, -1), "user_id", "ts", "event_id", "value", "temp",
                                    skip=3, thin=2, many=True)
    return rounded_fit(fits).withColumn("mean_temp", F.round("mean_temp", 7))


RATES_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_quantity,
    (l_discount - l_tax) * (6000 - CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity * 10 END) * 0.001 AS amount_rate
    FROM lineitem WHERE l_returnflag IN ('A', 'R'))"""
CORRECTED_SQL = f"""(SELECT r.*, (amount_rate - blank_rate) * 3.6 / l_quantity AS rate_corr, amount_rate * 3.6 / l_quantity AS rate_uncorr
    FROM {RATES_SQL} r LEFT JOIN (SELECT l_suppkey, l_returnflag, avg(amount_rate) AS blank_rate FROM {RATES_SQL}
                                  WHERE l_linestatus = 'F' GROUP BY ALL) USING (l_suppkey, l_returnflag)
    WHERE l_linestatus <> 'F')"""


def chamber_rows(t) -> DataFrame:
    rows = t.lineitem.filter(F.col("l_returnflag").isin("A", "R")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity",
        (F.col("l_discount") - F.col("l_tax")).alias("rate"),
        F.when(F.col("l_linestatus") != "F", F.col("l_quantity") * 10).alias("body_ml"))
    return respiro.chamber_rates(rows, "rate", "body_ml")


def corrected_rows(t) -> DataFrame:
    return respiro.blank_corrected(chamber_rows(t), ["l_suppkey", "l_returnflag"], F.col("l_linestatus") == "F",
                                   "amount_rate", "l_quantity")


@query("C13_chamber_volume", f"SELECT l_orderkey, l_linenumber, l_partkey, round(amount_rate, 7) AS amount_rate FROM {RATES_SQL}")
def c13(t):
    return chamber_rows(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round("amount_rate", 7).alias("amount_rate"))


@query("C14_blank_correction", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, round(rate_corr, 11) AS rate_corr, round(rate_uncorr, 11) AS rate_uncorr
    FROM {CORRECTED_SQL}""")
def c14(t):
    return corrected_rows(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round("rate_corr", 11).alias("rate_corr"),
                                    F.round("rate_uncorr", 11).alias("rate_uncorr"))


UNIT_SQL = f"""(SELECT l_partkey, l_returnflag, avg(rate_corr) AS rate_corr, avg(rate_uncorr) AS rate_uncorr,
    avg(l_quantity) AS temp FROM {CORRECTED_SQL} GROUP BY ALL)"""
PARTS_SQL = f"""(SELECT l_partkey, CASE l_returnflag WHEN 'R' THEN 'R' ELSE 'NP' END AS metric, l_returnflag AS light,
    CASE WHEN s * rate_corr < 0 THEN 0 ELSE s * rate_corr END AS rate_corr,
    CASE WHEN s * rate_uncorr < 0 THEN 0 ELSE s * rate_uncorr END AS rate_uncorr, temp
    FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN -1.0 ELSE 1.0 END AS s FROM {UNIT_SQL}) WHERE rate_corr IS NOT NULL)"""
PRODUCTION_SQL = f"""(SELECT * FROM {PARTS_SQL} UNION ALL SELECT l_partkey, 'GP', 'A', sum(rate_corr), sum(rate_uncorr), avg(temp)
    FROM {PARTS_SQL} GROUP BY 1)"""


def production_rows(t) -> DataFrame:
    unit = corrected_rows(t).groupBy("l_partkey", F.col("l_returnflag").alias("light")).agg(
        F.avg("rate_corr").alias("rate_corr"), F.avg("rate_uncorr").alias("rate_uncorr"), F.avg("l_quantity").alias("temp"))
    return respiro.production_table(unit, ["l_partkey"], "light", temp="temp", lit="A", dark="R")


@query("C15_production", f"""
    SELECT l_partkey, metric, light, round(rate_corr, 10) AS rate_corr, round(rate_uncorr, 10) AS rate_uncorr,
           round(temp, 7) AS temp FROM {PRODUCTION_SQL}""")
def c15(t):
    return production_rows(t).select("l_partkey", "metric", "light", F.round("rate_corr", 10).alias("rate_corr"),
                                     F.round("rate_uncorr", 10).alias("rate_uncorr"), F.round("temp", 7).alias("temp"))


SAMPLES_SQL = """(SELECT o_orderkey, o_orderstatus, o_totalprice - final AS gap, o_orderpriority = '1-URGENT' AS blank,
    6000 - qty AS volume, qty AS mass, 1 + o_orderkey % 5 AS hours, o_orderkey % 2000 AS l_partkey
    FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS final, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
    ON l_orderkey = o_orderkey)"""
NC_SQL = f"""(SELECT s.*, (gap - blank_gap) / 2 * 1.023 * volume / mass / hours / 1000 AS net_calcification FROM {SAMPLES_SQL} s
    LEFT JOIN (SELECT o_orderstatus, avg(gap) AS blank_gap FROM {SAMPLES_SQL} WHERE blank GROUP BY 1) USING (o_orderstatus)
    WHERE NOT blank)"""


def calcification_rows(t) -> DataFrame:
    final = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("final"), F.sum("l_quantity").alias("qty"))
    both = t.orders.join(final, "o_orderkey").withColumns(
        {"volume": 6000 - F.col("qty"), "mass": F.col("qty"), "hours": 1 + F.col("o_orderkey") % 5})
    last = F.when(F.col("o_orderpriority") == "1-URGENT", "BLANK").otherwise("BODY")
    long = both.select("o_orderkey", "o_orderstatus", "volume", "mass", "hours", F.explode(F.array(
        F.struct(F.lit("INITIAL").alias("grp"), F.col("o_totalprice").alias("ta")),
        F.struct(last.alias("grp"), F.col("final").alias("ta")))).alias("s")).select(
        "o_orderkey", "o_orderstatus", "volume", "mass", "hours", "s.grp", "s.ta")
    return respiro.calcification(long, ["o_orderstatus"], ["o_orderkey"], "grp", "ta", "volume", "mass", "hours")


@query("C16_net_calcification", f"SELECT o_orderkey, round(net_calcification, 5) AS net_calcification FROM {NC_SQL}")
def c16(t):
    return calcification_rows(t).select("o_orderkey", F.round("net_calcification", 5).alias("net_calcification"))


@query("C17_metabolic_long", f"""
    SELECT l_partkey AS unit, metric, round(rate_corr, 10) AS value FROM {PRODUCTION_SQL}
    UNION ALL SELECT o_orderkey, 'NC', round(net_calcification, 5) FROM {NC_SQL}""")
def c17(t):
    prod = production_rows(t).withColumn("unit", F.col("l_partkey"))
    nc = calcification_rows(t).withColumn("unit", F.col("o_orderkey"))
    long = respiro.metabolic_long(prod, nc, ["unit"])
    return long.withColumn("value", F.when(F.col("metric") == "NC", F.round("value", 5)).otherwise(F.round("value", 10)))


# --- chemistry -------------------------------------------------------------

@query("C18_total_ph", f"""
    SELECT event_id, round((11911.08 - 18.2499*sal - 0.039336*sal**2) / k - 366.27059 + 0.53993607*sal + 0.00016329*sal**2
        + (64.52243 - 0.084041*sal) * ln(k) - 0.11149858*k
        + ((b0 + b1*temp) - mv) / 1000 / (8.314472 * k * ln(10) / 96485.34), 7) AS ph
    FROM (SELECT *, temp + 273.15 AS k FROM {WATER_SQL}) JOIN
      (SELECT event_type, regr_intercept(mv, temp) AS b0, regr_slope(mv, temp) AS b1 FROM {WATER_SQL} GROUP BY 1)
    USING (event_type)""")
def c18(t):
    w = water_rows(t)
    p = chemistry.ph_from_buffer(w, w, ["event_type"], "mv", "temp", "mv", "temp", "sal")
    return p.select("event_id", F.round("ph", 7).alias("ph"))


@query("C19_site_water", f"""
    SELECT event_type, round(avg(sal), 7) AS mean_sal, round(stddev_samp(sal)/sqrt(count(*)), 8) AS se_sal, min(sal) AS min_sal,
           max(sal) AS max_sal, max(sal) - min(sal) AS range_sal, round(avg(temp), 7) AS mean_temp,
           round(stddev_samp(temp)/sqrt(count(*)), 8) AS se_temp, min(temp) AS min_temp, max(temp) AS max_temp,
           max(temp) - min(temp) AS range_temp FROM {WATER_SQL} GROUP BY 1""")
def c19(t):
    s = chemistry.site_water_summary(water_rows(t), ["event_type"], {"sal": "sal", "temp": "temp"})
    return s.withColumns({c: F.round(c, 7) for c in ("mean_sal", "mean_temp")}).withColumns(
        {c: F.round(c, 8) for c in ("se_sal", "se_temp")})


PSS_SQL = f"""(SELECT event_id, tt, (0.0080 - 0.1692*sqrt(rt) + 25.3851*rt + 14.0941*rt**1.5 - 7.0261*rt**2 + 2.7081*rt**2.5)
    + (tt - 15) / (1 + 0.0162*(tt - 15)) * (0.0005 - 0.0056*sqrt(rt) - 0.0066*rt - 0.0375*rt**1.5 + 0.0636*rt**2 - 0.0144*rt**2.5) AS salinity
    FROM (SELECT event_id, tt, r / (rp * (0.6766097 + 2.00564e-2*tt + 1.104259e-4*tt**2 - 6.9698e-7*tt**3 + 1.0031e-9*tt**4)) AS rt FROM
      (SELECT *, 1 + 10.0*(2.070e-5 - 6.370e-10*10 + 3.989e-15*100) / (1 + 3.426e-2*tt + 4.464e-4*tt**2 + (4.215e-1 - 3.107e-3*tt)*r) AS rp
       FROM (SELECT event_id, cond / 42.914 AS r, temp * 1.00024 AS tt FROM {WATER_SQL}))))"""


@query("C20_practical_salinity", f"SELECT event_id, round(salinity, 8) AS salinity FROM {PSS_SQL}")
def c20(t):
    s = water_rows(t).withColumn("salinity", water.practical_salinity("cond", "temp", 10.0))
    return s.select("event_id", F.round("salinity", 8).alias("salinity"))


@query("C29_nutrient_summary", """
    SELECT CASE l_returnflag WHEN 'A' THEN 'Low' WHEN 'R' THEN 'High' ELSE l_returnflag END AS site, parameter,
           round(avg(value), 7) AS mean, round(stddev_samp(value), 7) AS sd, round(stddev_samp(value)/sqrt(count(value)), 9) AS se
    FROM (SELECT l_returnflag, l_quantity, l_tax FROM lineitem WHERE l_returnflag <> 'N')
    UNPIVOT (value FOR parameter IN (l_quantity, l_tax)) GROUP BY ALL""")
def c29(t):
    rows = t.lineitem.withColumn("sample", F.concat_ws("_", "l_returnflag", "l_linestatus"))
    s = chemistry.nutrient_summary(rows.select("sample", "l_quantity", "l_tax"), "sample", ["l_quantity", "l_tax"], ["N"],
                                   {"A": "Low", "R": "High"})
    return s.withColumns({"mean": F.round("mean", 7), "sd": F.round("sd", 7), "se": F.round("se", 9)})


@query("C30_chemistry_long", """
    SELECT site, parameter, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS sd,
           round(stddev_samp(value)/sqrt(count(value)), 6) AS se FROM
      (SELECT coalesce(a.site, b.site) AS site, quantity, tax, o_totalprice FROM
        (SELECT l_orderkey, l_orderkey % 3 AS site, sum(l_quantity) AS quantity, sum(l_tax) AS tax FROM lineitem GROUP BY ALL) a
       FULL JOIN (SELECT o_orderkey, o_orderkey % 3 AS site, o_totalprice FROM orders WHERE o_orderstatus <> 'P') b
       ON l_orderkey = o_orderkey)
    UNPIVOT INCLUDE NULLS (value FOR parameter IN (quantity, tax, o_totalprice)) GROUP BY ALL""")
def c30(t):
    key = F.col("l_orderkey")
    a = t.lineitem.groupBy(key.alias("orderkey"), (key % 3).alias("site")).agg(
        F.sum("l_quantity").alias("quantity"), F.sum("l_tax").alias("tax"))
    key = F.col("o_orderkey")
    b = t.orders.filter("o_orderstatus <> 'P'").select(key.alias("orderkey"), (key % 3).alias("site"), "o_totalprice")
    long = chemistry.chemistry_long(a, b, ["orderkey", "site"], ["quantity", "tax", "o_totalprice"])
    return chemistry.parameter_summary(long, ["site"]).withColumns(
        {"mean": F.round("mean", 5), "sd": F.round("sd", 5), "se": F.round("se", 6)})


# --- community -------------------------------------------------------------

@query("C31_dominant_taxa", """
    SELECT l_returnflag, p_brand, rank, round(cover, 1) AS cover, p_size_class FROM
      (SELECT l_returnflag, p_brand, cover, row_number() OVER (PARTITION BY l_returnflag ORDER BY cover DESC, p_brand) AS rank FROM
        (SELECT l_returnflag, p_brand, 100 * q / sum(q) OVER (PARTITION BY l_returnflag) AS cover FROM
          (SELECT l_returnflag, p_brand, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))
       WHERE p_brand NOT IN ('Brand#1', 'Brand#2') AND NOT (l_returnflag = 'A' AND p_brand = 'Brand#7'))
    LEFT JOIN (SELECT p_brand, max(p_size) AS p_size_class FROM part GROUP BY 1) USING (p_brand) WHERE rank <= 8""")
def c31(t):
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_returnflag", "p_brand", "l_quantity")
    unused = S.literal_table(t.spark, [("Brand#1",), ("Brand#2",)], "p_brand string")
    skip = (F.col("l_returnflag") == "A") & (F.col("p_brand") == "Brand#7")
    top = community.dominant_taxa(items, "l_returnflag", "p_brand", "l_quantity", 8, unused, skip)
    traits = t.part.groupBy("p_brand").agg(F.max("p_size").alias("p_size_class"))
    return community.with_traits(top, traits, "p_brand")


@query("C32_trait_decode", """
    SELECT p_partkey, p_type AS phylum, ['Branching', 'Massive', 'Encrusting', 'Cushion-like', 'Polypoid', 'Fil'][1 + p_size % 6] AS morphology,
           ['Heratypic', 'Non-calcifying', 'Articulated', 'Non-articulated'][1 + p_size % 4] AS calcification,
           ['Mixotrophic', 'Autotrophic', 'Heterotrophic'][1 + p_size % 3] AS resource FROM part""")
def c32(t):
    def pick(codes):
        return F.element_at(F.array(*[F.lit(c) for c in codes]), (1 + F.col("p_size") % len(codes)).cast("int"))
    entity = F.concat_ws(",", "p_type", pick([*community.SHAPES, "Fil"]), pick(list(community.CALCIFYING)),
                         pick(list(community.RESOURCES)))
    d = community.decode_traits(t.part.select("p_partkey", entity.alias("entity")), "entity")
    return d.select("p_partkey", "phylum", "morphology", "calcification", "resource")


@query("C33_site_points", """
    SELECT location, round(quantile_cont(CASE WHEN s_nationkey = 3 THEN s_acctbal + CAST(0.5 AS DOUBLE) ELSE s_acctbal END, 0.5), 6) AS lat,
           round(quantile_cont(CASE WHEN s_nationkey = 3 THEN CAST(s_suppkey AS DOUBLE) + 0.25 ELSE CAST(s_suppkey AS DOUBLE) END, 0.5), 6) AS lon
    FROM (SELECT *, s_nationkey % 2 AS location FROM supplier) WHERE s_nationkey IN (1, 3, 5, 8, 10) GROUP BY 1""")
def c33(t):
    sites = t.supplier.select("s_nationkey", (F.col("s_nationkey") % 2).alias("location"), F.col("s_acctbal").alias("y"),
                              F.col("s_suppkey").cast("double").alias("x"))
    pts = community.site_points(sites, "s_nationkey", [1, 3, 5, 8, 10], {3: (0.5, 0.25)}, "y", "x")
    c = community.map_centre(pts, ["location"], "y", "x")
    return c.select("location", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
