"""Statistics jobs on the given tables.

Tail probabilities are stated in SQL where a closed form exists: with an even
number of numerator degrees of freedom the F tail is a finite sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import anova, mixed, regression
from ..operators.ordered import every_kth
from ..functions import normal
from .joins import FIT_COLUMNS, rounded_fit
from .local_sql import ranked_local_regression_sql
from .mixed_sql import random_intercept_sql, random_intercept_test_sql
from .registry import query
from .tail_sql import horner, normal_upper_sql, one_df_tail_ctes, range_tail_ctes, signif_sql, text_sql


def factorial(t) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")


# --- lines -----------------------------------------------------------------

LINE_SQL = """(SELECT event_type, regr_count(value, user_id) AS n, regr_slope(value, user_id) AS slope,
    regr_intercept(value, user_id) AS intercept, regr_r2(value, user_id) AS r2, regr_sxx(value, user_id) AS sxx,
    regr_syy(value, user_id) AS syy, regr_avgx(value, user_id) AS mx, min(user_id) AS lo, max(user_id) AS hi
    FROM events GROUP BY 1)"""


@query("T1_line_fit", f"""
    SELECT event_type, n, round(slope, 9) AS slope, round(intercept, 7) AS intercept, round(r2, 9) AS r2,
           round(se, 9) AS se_slope, round(slope / se, 6) AS t_slope FROM
      (SELECT *, sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS se FROM {LINE_SQL})""")
def t1(t):
    f = regression.line_fit(t.events, ["event_type"], "user_id", "value")
    return f.select("event_type", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 7).alias("intercept"),
                    F.round("r2", 9).alias("r2"), F.round("se_slope", 9).alias("se_slope"), F.round("t_slope", 6).alias("t_slope"))


BAND_SQL = f"""(SELECT *, lo + (hi - lo) * grid / 79.0 AS x, (syy - slope*slope*sxx) / (n - 2) AS mse,
    (1.959963984540054 + (1.959963984540054**3 + 1.959963984540054) / (4*(n-2))
     + (5*1.959963984540054**5 + 16*1.959963984540054**3 + 3*1.959963984540054) / (96*(n-2)**2)
     + (3*1.959963984540054**7 + 19*1.959963984540054**5 + 17*1.959963984540054**3 - 15*1.959963984540054) / (384*(n-2)**3)) AS tq
    FROM {LINE_SQL}, (SELECT unnest(range(80)) AS grid))"""


@query("V4_line_band", f"""
    SELECT event_type, grid, round(x, 6) AS x, round(intercept + slope*x, 5) AS fit,
           round(intercept + slope*x - tq*sqrt(mse*(1.0/n + (x-mx)**2/sxx)), 5) AS low,
           round(intercept + slope*x + tq*sqrt(mse*(1.0/n + (x-mx)**2/sxx)), 5) AS high FROM {BAND_SQL}""")
def v4(t):
    b = regression.line_band(t.events, ["event_type"], "user_id", "value")
    return b.select("event_type", "grid", F.round("x", 6).alias("x"), F.round("fit", 5).alias("fit"),
                    F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


# --- analysis of variance --------------------------------------------------

def one_way_sql(cells: str, extra: str = "") -> str:
    """One-way table over cells(n, m, ss); the p-value holds for two factor degrees of freedom."""
    return f"""(SELECT count(*) - 1 AS df_factor, CAST(sum(n) - count(*) AS BIGINT) AS df_residual, sum(n*(m - grand)**2) AS ss_factor,
        sum(ss) AS ss_residual, (sum(n*(m - grand)**2) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f_value {extra}
        FROM (SELECT *, (SELECT sum(n*m)/sum(n) FROM {cells}) AS grand FROM {cells}))"""


FLAG_CELLS = """(SELECT l_returnflag, count(l_quantity) AS n, avg(l_quantity) AS m, var_pop(l_quantity) * count(l_quantity) AS ss
    FROM lineitem GROUP BY 1)"""
ANOVA_COLUMNS = """df_factor, df_residual, round(ss_factor, 5) AS ss_factor, round(ss_residual, 3) AS ss_residual,
    round(f_value, 7) AS f_value, round(pow(1 + 2*f_value/df_residual, -df_residual/2), 8) AS p"""


def anova_columns(df: DataFrame) -> DataFrame:
    return df.select("df_factor", "df_residual", F.round("ss_factor", 5).alias("ss_factor"),
                     F.round("ss_residual", 3).alias("ss_residual"), F.round("f_value", 7).alias("f_value"),
                     F.round("p", 8).alias("p"))


@query("T2_one_way", f"SELECT {ANOVA_COLUMNS} FROM {one_way_sql(FLAG_CELLS)}")
def t2(t):
    return anova_columns(anova.one_way(factorial(t), [], "l_returnflag", "l_quantity"))


CELLS_SQL = """(SELECT l_returnflag AS a, l_linestatus AS b, count(l_quantity) AS n, avg(l_quantity) AS m,
    var_pop(l_quantity) * count(l_quantity) AS ss FROM lineitem GROUP BY ALL)"""
TWO_WAY_SQL = f"""
    WITH c AS {CELLS_SQL}, g AS (SELECT sum(n*m)/sum(n) AS grand, sum(n) AS rows, sum(ss) AS ssr, count(*) AS cells FROM c),
    ra AS (SELECT a, sum(n) AS na, sum(n*m)/sum(n) AS ma FROM c GROUP BY a),
    pair AS (SELECT x.a, x.n*y.n/(x.n + y.n) AS w, x.m - y.m AS d FROM c x JOIN c y ON x.a = y.a AND x.b = 'F' AND y.b = 'O'),
    sa AS (SELECT sum(na*(ma - grand)**2) AS s FROM ra, g), sb AS (SELECT sum(w*d)**2 / sum(w) AS s FROM pair),
    sall AS (SELECT sum(n*(m - grand)**2) AS s FROM c, g),
    tab AS (SELECT 'l_returnflag' AS source, CAST(2 AS DOUBLE) AS df, s AS ss FROM sa UNION ALL SELECT 'l_linestatus', 1, s FROM sb
        UNION ALL SELECT 'l_returnflag x l_linestatus', 2, sall.s - sa.s - sb.s FROM sall, sa, sb
        UNION ALL SELECT 'residual', CAST(rows - cells AS DOUBLE), ssr FROM g)"""


@query("T3_two_way", TWO_WAY_SQL + """
    SELECT source, df, round(ss, 3) AS ss, round(ss/df, 4) AS ms,
           CASE WHEN source <> 'residual' THEN round((ss/df) / (SELECT ss/df FROM tab WHERE source = 'residual'), 6) END AS f_value FROM tab""")
def t3(t):
    w = anova.two_way(factorial(t), [], "l_returnflag", "l_linestatus", "l_quantity", p_value=False)
    return w.select("source", "df", F.round("ss", 3).alias("ss"), F.round("ms", 4).alias("ms"), F.round("f_value", 6).alias("f_value"))


@query("T4_pairwise_contrasts", f"""
    WITH c AS (SELECT a || ' ' || b AS cell, n, m, ss FROM {CELLS_SQL}),
    g AS (SELECT sum(ss)/(sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS BIGINT) AS df FROM c)
    SELECT x.cell AS cell_1, y.cell AS cell_2, round(x.m - y.m, 7) AS estimate, round(sqrt(mse*(1.0/x.n + 1.0/y.n)), 8) AS std_error,
           df, round((x.m - y.m) / sqrt(mse*(1.0/x.n + 1.0/y.n)), 6) AS t_ratio FROM c x JOIN c y ON x.cell < y.cell, g""")
def t4(t):
    p = anova.pairwise(factorial(t), [], ["l_returnflag", "l_linestatus"], "l_quantity", p_value=False)
    return p.select("cell_1", "cell_2", F.round("estimate", 7).alias("estimate"), F.round("std_error", 8).alias("std_error"),
                    "df", F.round("t_ratio", 6).alias("t_ratio"))


@query("T4_adjusted_p", f"""
    WITH c AS (SELECT a || ' ' || b AS cell, n, m, ss FROM {CELLS_SQL}),
    g AS (SELECT sum(ss)/(sum(n) - count(*)) AS mse, CAST(sum(n) - count(*) AS BIGINT) AS df, count(*) AS k FROM c),
    pairs AS (SELECT *, estimate/std_error AS t_ratio, abs(estimate/std_error)*sqrt(2.0) AS q FROM
      (SELECT x.cell AS cell_1, y.cell AS cell_2, x.m - y.m AS estimate, sqrt(mse*(1.0/x.n + 1.0/y.n)) AS std_error, df, k
       FROM c x JOIN c y ON x.cell < y.cell, g)), {range_tail_ctes('pairs')}
    SELECT cell_1, cell_2, round(estimate, 7) AS estimate, round(std_error, 8) AS std_error, df, k, round(t_ratio, 6) AS t_ratio,
           round(p, 7) AS p_adj FROM tails""")
def t4_p(t):
    p = anova.pairwise(factorial(t), [], ["l_returnflag", "l_linestatus"], "l_quantity")
    return p.select("cell_1", "cell_2", F.round("estimate", 7).alias("estimate"), F.round("std_error", 8).alias("std_error"),
                    "df", "k", F.round("t_ratio", 6).alias("t_ratio"), F.round("p_adj", 7).alias("p_adj"))


@query("T5_level_means", """
    SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 5) AS mean FROM orders GROUP BY 1""")
def t5_means(t):
    g = anova.grouping_letters(t.orders, [], "o_orderpriority", "o_totalprice", ["o_orderstatus"])
    return g.select("o_orderpriority", "n", F.round("mean", 5).alias("mean"))


def letters_sql(table: str, factor: str, model: str, y: str) -> str:
    """All sets of a few levels without a differing pair; those that no other such set holds get the letters."""
    return f"""
    WITH c AS (SELECT {factor} AS f, count({y}) AS n, avg({y}) AS m, var_pop({y})*count({y}) AS ss FROM {table} GROUP BY {factor}, {model}),
    g AS (SELECT sum(ss)/(sum(n) - count(*)) AS mse, sum(n) - count(*) AS df, count(DISTINCT f) AS k FROM c),
    lev AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY m DESC, f) - 1 AS i FROM (SELECT f, sum(n) AS n, sum(n*m)/sum(n) AS m FROM c GROUP BY f)),
    pairs AS (SELECT x.i AS i1, y.i AS i2, abs(x.m - y.m)/sqrt(mse/2*(1.0/x.n + 1.0/y.n)) AS q, k, CAST(df AS DOUBLE) AS df
              FROM lev x JOIN lev y ON x.i < y.i, g), {range_tail_ctes('pairs')},
    sets AS MATERIALIZED (SELECT z, list_filter(range(k), lambda i: (z >> i) & 1 = 1) AS members FROM
        (SELECT k, unnest(range(1, CAST(pow(2, k) AS BIGINT))) AS z FROM g)
        WHERE NOT EXISTS (SELECT 1 FROM tails WHERE p < 0.05 AND (z >> i1) & 1 = 1 AND (z >> i2) & 1 = 1)),
    top AS (SELECT z, row_number() OVER (ORDER BY members) AS rank FROM sets s WHERE NOT EXISTS (SELECT 1 FROM sets o WHERE o.z <> s.z AND o.z & s.z = s.z))
    SELECT f AS {factor}, CAST(n AS BIGINT) AS n, round(m, 5) AS mean, string_agg(chr(CAST(96 + rank AS INTEGER)), '' ORDER BY rank) AS letters
    FROM lev JOIN top ON (z >> i) & 1 = 1 GROUP BY ALL"""


@query("T5_grouping_letters", letters_sql("orders", "o_orderpriority", "o_orderstatus", "o_totalprice"))
def t5(t):
    g = anova.grouping_letters(t.orders, [], "o_orderpriority", "o_totalprice", ["o_orderstatus"])
    return g.withColumn("mean", F.round("mean", 5))


@query("T5_overlapping_letters", letters_sql(
    "(SELECT floor(l_discount*100/3 + 0.001) AS step, l_returnflag, l_extendedprice*(1 - l_discount) AS paid FROM lineitem)", "step", "l_returnflag", "paid"))
def t5_overlap(t):
    """Steps of the discount, next ones too near to tell apart."""
    rows = t.lineitem.select(F.floor(F.col("l_discount") * 100 / 3 + 0.001).cast("double").alias("step"), "l_returnflag",
                             (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    return anova.grouping_letters(rows, [], "step", "paid", ["l_returnflag"]).withColumn("mean", F.round("mean", 5))


@query("T6_linear_model", """
    WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2,
        var_pop(l_quantity)*count(*) AS s11, var_pop(l_tax)*count(*) AS s22, covar_pop(l_quantity, l_tax)*count(*) AS s12,
        covar_pop(l_quantity, l_extendedprice)*count(*) AS s1y, covar_pop(l_tax, l_extendedprice)*count(*) AS s2y,
        var_pop(l_extendedprice)*count(*) AS syy FROM lineitem),
    b AS (SELECT *, s11*s22 - s12*s12 AS det, (s22*s1y - s12*s2y)/(s11*s22 - s12*s12) AS b1, (s11*s2y - s12*s1y)/(s11*s22 - s12*s12) AS b2 FROM s),
    r AS (SELECT *, (syy - b1*s1y - b2*s2y)/(n - 3) AS mse, 1 - (syy - b1*s1y - b2*s2y)/syy AS r2 FROM b)
    SELECT term, round(estimate, 5) AS estimate, round(se, 5) AS std_error, round(estimate/se, 5) AS t, CAST(n - 3 AS DOUBLE) AS df, round(r2, 8) AS r2 FROM
      (SELECT 'l_quantity' AS term, b1 AS estimate, sqrt(mse*s22/det) AS se, n, r2 FROM r
       UNION ALL SELECT 'l_tax', b2, sqrt(mse*s11/det), n, r2 FROM r
       UNION ALL SELECT 'intercept', my - b1*m1 - b2*m2,
             sqrt(mse*(1.0/n + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/det)), n, r2 FROM r)""")
def t6(t):
    m = regression.linear_model(t.lineitem, [], "l_extendedprice", {"l_quantity": F.col("l_quantity"), "l_tax": F.col("l_tax")},
                                p_value=False)
    return m.select("term", F.round("estimate", 5).alias("estimate"), F.round("std_error", 5).alias("std_error"),
                    F.round("t", 5).alias("t"), "df", F.round("r2", 8).alias("r2"))


@query("T7_cluster_sizes", """
    SELECT l_linestatus, size, count(*) AS m, round(sum(my * size), 2) AS total, round(sum(mx * size), 2) AS marked FROM
      (SELECT l_linestatus, l_orderkey, count(*) AS size, avg(l_quantity) AS my, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS mx
       FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def t7_sizes(t):
    rows = t.lineitem.select("l_orderkey", (F.col("l_returnflag") == "R").cast("double").alias("x"), "l_quantity", "l_linestatus")
    sums = mixed.size_classes(rows, ["l_linestatus"], ["l_orderkey"], "x", "l_quantity")
    centre = rows.groupBy("l_linestatus").agg(F.avg("x").alias("cx"), F.avg("l_quantity").alias("cy"))
    at = F.col("m") * F.col("size")
    return sums.join(centre, "l_linestatus").select(
        "l_linestatus", "size", "m", F.round(F.col("sy") + at * F.col("cy"), 2).alias("total"),
        F.round(F.col("sx") + at * F.col("cx"), 2).alias("marked"))


ORDER_ROWS_SQL = """
    (SELECT l_linestatus AS k, l_orderkey AS g, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x, l_quantity AS y
     FROM lineitem)"""


def order_fit(t) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", (F.col("l_returnflag") == "R").cast("double").alias("x"), "l_quantity", "l_linestatus")
    return mixed.random_intercept(rows, ["l_linestatus"], ["l_orderkey"], "x", "l_quantity")


@query("T7_reml_fit", f"""
    SELECT k AS l_linestatus, round(theta, 5) AS ratio, round(slope, 5) AS estimate, round(s2, 2) AS residual_variance,
           round(f_value, 5) AS f_value FROM ({random_intercept_sql(ORDER_ROWS_SQL)})""")
def t7_fit(t):
    return order_fit(t).select("l_linestatus", F.round("ratio", 5).alias("ratio"), F.round("estimate", 5).alias("estimate"),
                               F.round("residual_variance", 2).alias("residual_variance"), F.round("f_value", 5).alias("f_value"))


@query("T7_random_intercept", f"""
    SELECT k AS l_linestatus, round(slope, 5) AS estimate, round(theta, 5) AS ratio, round(s2, 2) AS residual_variance,
           round(f*s2, 2) AS ss, round(f*s2, 2) AS ms, 1.0::DOUBLE AS num_df, round(den, 1) AS den_df, round(f, 5) AS f_value,
           round(p, 6) AS p, false AS at_limit FROM ({random_intercept_test_sql(ORDER_ROWS_SQL)})""")
def t7(t):
    places = {"estimate": 5, "ratio": 5, "residual_variance": 2, "ss": 2, "ms": 2, "den_df": 1, "f_value": 5, "p": 6}
    return order_fit(t).withColumns({c: F.round(c, d) for c, d in places.items()})


# Series of many keys: parts sold within orders of a supplier's line of goods.
SUPPLIER_ROWS_SQL = """
    (SELECT l_suppkey AS k, l_partkey AS g, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x,
            l_quantity + l_partkey % 11 AS y FROM lineitem)"""


@query("T7_many_keys", f"""
    SELECT k AS l_suppkey, round(slope, 4) AS estimate, round(theta, 4) AS ratio, round(den, 1) AS den_df, round(p, 5) AS p
    FROM ({random_intercept_test_sql(SUPPLIER_ROWS_SQL)})""")
def t7_many(t):
    rows = t.lineitem.select("l_suppkey", "l_partkey", (F.col("l_linestatus") == "F").cast("double").alias("x"),
                             (F.col("l_quantity") + F.col("l_partkey") % 11).alias("y"))
    fit = mixed.random_intercept(rows, ["l_suppkey"], ["l_partkey"], "x", "y")
    return fit.select("l_suppkey", F.round("estimate", 4).alias("estimate"), F.round("ratio", 4).alias("ratio"),
                      F.round("den_df", 1).alias("den_df"), F.round("p", 5).alias("p"))


LEVENE_CELLS = """(SELECT l_returnflag, count(*) AS n, avg(d) AS m, var_pop(d)*count(*) AS ss FROM
    (SELECT l_returnflag, abs(l_extendedprice - med) AS d FROM lineitem JOIN
      (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS med FROM lineitem GROUP BY 1) USING (l_returnflag)) GROUP BY 1)"""


@query("T8_levene", f"""
    SELECT df_factor, df_residual, round(f_value, 6) AS f_value, round(pow(1 + 2*f_value/df_residual, -df_residual/2), 8) AS p
    FROM {one_way_sql(LEVENE_CELLS)}""")
def t8(t):
    lv = anova.levene(t.lineitem, [], ["l_returnflag"], "l_extendedprice")
    return lv.select("df_factor", "df_residual", F.round("f_value", 6).alias("f_value"), F.round("p", 8).alias("p"))


def normal_quantile_sql(p: str) -> str:
    """The published approximation written as one SQL expression."""
    q, s = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"{q} * {horner(f'(0.180625 - {q} * {q})', normal.CENTRE_TOP)} / {horner(f'(0.180625 - {q} * {q})', normal.CENTRE_BOTTOM)}"
    middle = f"{horner(f'({s} - 1.6)', normal.MIDDLE_TOP)} / {horner(f'({s} - 1.6)', normal.MIDDLE_BOTTOM)}"
    tail = f"{horner(f'({s} - 5.0)', normal.TAIL_TOP)} / {horner(f'({s} - 5.0)', normal.TAIL_BOTTOM)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE sign({q}) * CASE WHEN {s} <= 5 THEN {middle} ELSE {tail} END END"


QQ_SQL = """(SELECT l_returnflag, l_quantity, i, (i - 0.5) / n AS pr, (i - 0.375) / (n + 0.25) AS ps, n FROM
    (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey) AS i,
            count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem))"""


@query("T9_shapiro_wilk", f"""
    WITH r AS (SELECT event_type, n, i, value AS v, {normal_quantile_sql('((i - 0.375) / (n + 0.25))')} AS z FROM
        (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
                count(*) OVER (PARTITION BY event_type) AS n FROM events)),
    s AS (SELECT event_type, max(n) AS n, var_pop(v)*count(*) AS ss, sum(z*z) AS zz, sum(z*v) AS zv, max(z) AS z1, max(z) FILTER (i = n - 1) AS z2,
          max(v) - min(v) AS e1, max(v) FILTER (i = n - 1) - max(v) FILTER (i = 2) AS e2, 1/sqrt(max(n)) AS u FROM r GROUP BY 1),
    a AS (SELECT *, z1/sqrt(zz) + 0.221157*u - 0.147981*u**2 - 2.071190*u**3 + 4.434685*u**4 - 2.706056*u**5 AS a1,
                 z2/sqrt(zz) + 0.042981*u - 0.293762*u**2 - 1.752461*u**3 + 5.682633*u**4 - 3.582633*u**5 AS a2 FROM s)
    SELECT event_type, n, round((a1*e1 + a2*e2 + (zv - z1*e1 - z2*e2) / sqrt((zz - 2*z1**2 - 2*z2**2)/(1 - 2*a1**2 - 2*a2**2)))**2 / ss, 8) AS w
    FROM a""")
def t9(t):
    s = anova.shapiro_wilk(t.events, ["event_type"], "value", ["event_id"])
    return s.select("event_type", "n", F.round("w", 8).alias("w"))


@query("T9_shapiro_p", f"""
    WITH r AS (SELECT user_id, n, i, value AS v, {normal_quantile_sql('((i - 0.375) / (n + 0.25))')} AS z FROM
        (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)),
    s AS (SELECT user_id, max(n) AS n, var_pop(v)*count(*) AS ss, sum(z*z) AS zz, sum(z*v) AS zv, max(z) AS z1, max(z) FILTER (i = n - 1) AS z2,
          max(v) - min(v) AS e1, max(v) FILTER (i = n - 1) - max(v) FILTER (i = 2) AS e2, 1/sqrt(max(n)) AS u FROM r GROUP BY 1),
    a AS (SELECT *, z1/sqrt(zz) + {horner('u', anova.ROYSTON_LAST)} AS a1, z2/sqrt(zz) + {horner('u', anova.ROYSTON_SECOND)} AS a2
          FROM s WHERE n >= 3 AND ss > 0),
    w AS (SELECT *, least(1.0, CASE WHEN n = 3 THEN e1*e1/2 WHEN n <= 5 THEN (a1*e1 + (zv - z1*e1)/sqrt((zz - 2*z1**2)/(1 - 2*a1**2)))**2
          ELSE (a1*e1 + a2*e2 + (zv - z1*e1 - z2*e2)/sqrt((zz - 2*z1**2 - 2*z2**2)/(1 - 2*a1**2 - 2*a2**2)))**2 END / ss) AS w FROM a),
    y AS (SELECT *, CASE WHEN w < 1 THEN ln(1 - w) ELSE '-infinity'::DOUBLE END AS y, ln(n) AS size, {horner('n', anova.ROYSTON_GAMMA)} AS edge FROM w),
    z AS (SELECT *, CASE WHEN n > 11 THEN (y - {horner('size', anova.ROYSTON_LARGE_MEAN)})/exp({horner('size', anova.ROYSTON_LARGE_SD)})
          WHEN y < edge THEN (-ln(edge - y) - {horner('n', anova.ROYSTON_SMALL_MEAN)})/exp({horner('n', anova.ROYSTON_SMALL_SD)})
          ELSE 'infinity'::DOUBLE END AS score FROM y)
    SELECT s.user_id, s.n, round(w, 8) AS w, s.n <= {anova.PUBLISHED_ROWS} AS p_published, round(CASE WHEN s.n = 3
        THEN greatest(0, 6/pi()*(asin(sqrt(w)) - asin(sqrt(0.75)))) ELSE {normal_upper_sql('score')} END, 9) AS p
    FROM s LEFT JOIN z USING (user_id)""")
def t9_p(t):
    """Small groups, where the published p-value applies."""
    s = anova.shapiro_wilk(t.events, ["user_id"], "value", ["event_id"])
    return s.select("user_id", "n", F.round("w", 8).alias("w"), "p_published", F.round("p", 9).alias("p"))


@query("T10_qq_points", f"""
    SELECT l_returnflag, l_quantity, i, round({normal_quantile_sql('pr')}, 8) AS theoretical FROM {QQ_SQL}""")
def t10(t):
    rows = t.lineitem.select("l_returnflag", "l_quantity", "l_orderkey")
    q = anova.qq_points(rows, ["l_returnflag"], "l_quantity", ["l_orderkey"])
    return q.select("l_returnflag", "l_quantity", "i", F.round("theoretical", 8).alias("theoretical"))


@query("T11_diagnostics", f"""
    WITH c AS {CELLS_SQL}, g AS (SELECT sum(ss)/(sum(n) - count(*)) AS mse, count(*) AS p FROM c)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(m, 6) AS fitted, round(l_quantity - m, 6) AS residual, round(1.0/n, 9) AS leverage,
           round((l_quantity - m)/sqrt(mse*(1 - 1.0/n)), 7) AS std_residual,
           round(((l_quantity - m)/sqrt(mse*(1 - 1.0/n)))**2 * (1.0/n) / ((1 - 1.0/n)*p), 10) AS cooks_distance
    FROM lineitem JOIN c ON l_returnflag = a AND l_linestatus = b, g""")
def t11(t):
    d = anova.two_way_diagnostics(factorial(t), "l_returnflag", "l_linestatus", "l_quantity")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("fitted", 6).alias("fitted"),
                    F.round("residual", 6).alias("residual"), F.round("leverage", 9).alias("leverage"),
                    F.round("std_residual", 7).alias("std_residual"), F.round("cooks_distance", 10).alias("cooks_distance"))


@query("T12_ranked_local_regression", f"SELECT {FIT_COLUMNS} FROM (" + ranked_local_regression_sql("""
    (SELECT user_id AS file, CAST(n AS DOUBLE) AS x, value AS y FROM
      (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n % 2 = 0)""") + ")")
def t12(t):
    """Each user's readings in order of time, thinned to every second one."""
    from ..plans.local_regression import ranked_local_regression
    rows = every_kth(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], 2, name="sec")
    return rounded_fit(ranked_local_regression(rows, "user_id", "sec", "value", 0.5))


STAR_SQL = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"


@query("T13_display_table", f"""
    SELECT shipyear, df_factor, {STAR_SQL} AS star, round(p, 6) AS p FROM
      (SELECT shipyear, df_factor, pow(1 + 2*f_value/df_residual, -df_residual/2) AS p FROM
        (SELECT shipyear, count(*) - 1 AS df_factor, sum(n) - count(*) AS df_residual,
                (sum(n*(m - grand)**2)/(count(*) - 1)) / (sum(ss)/(sum(n) - count(*))) AS f_value FROM
          (SELECT *, sum(n*m) OVER (PARTITION BY shipyear) / sum(n) OVER (PARTITION BY shipyear) AS grand FROM
            (SELECT year(l_shipdate) AS shipyear, l_returnflag, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity)*count(*) AS ss
             FROM lineitem GROUP BY ALL)) GROUP BY 1))""")
def t13(t):
    from ..functions.columns import stars
    rows = t.lineitem.select(F.year("l_shipdate").alias("shipyear"), "l_returnflag", "l_quantity")
    a = anova.one_way(rows, ["shipyear"], "l_returnflag", "l_quantity")
    return a.select("shipyear", "df_factor", stars("p").alias("star"), F.round("p", 6).alias("p"))


TESTED_SQL = TWO_WAY_SQL + f""",
    tested AS (SELECT source, df AS num, ss, ss/df AS ms, (ss/df) / (SELECT ss/df FROM tab WHERE source = 'residual') AS f,
                      (SELECT df FROM tab WHERE source = 'residual') AS den FROM tab WHERE source <> 'residual'),
    {one_df_tail_ctes("(SELECT source, f, den FROM tested WHERE num = 1)")},
    ps AS (SELECT source, f, p FROM f_tails UNION ALL SELECT source, f, pow(1 + 2*f/den, -den/2) FROM tested WHERE num = 2),
    shown AS (SELECT source, {signif_sql('df')} AS df, {signif_sql('ss')} AS ss, {signif_sql('(ss/df)')} AS ms, {signif_sql('f')} AS f, {signif_sql('p')} AS p
              FROM tab LEFT JOIN ps USING (source))"""


@query("T13_formatted_table", TESTED_SQL + f"""
    SELECT source, df, ss, ms, coalesce({text_sql('f')}, '-') AS f_value, coalesce({text_sql('p')} || ' ' || ({STAR_SQL}), '-') AS p FROM shown""")
def t13_text(t):
    w = anova.two_way(factorial(t), [], "l_returnflag", "l_linestatus", "l_quantity")
    return anova.display_table(w, ["source"], ["df", "ss", "ms"])
