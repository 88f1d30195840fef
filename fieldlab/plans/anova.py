"""Analysis of variance, contrasts and assumption checks from cell summaries.

Every job first reduces rows to one line per cell (n, mean, squared deviation),
merged stably on the map side. Only cells reach the numpy steps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from string import ascii_letters

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import dash_if_null, signif, stars, unite
from ..functions.normal import normal_quantile, normal_upper
from ..functions.studentised import range_tails
from ..functions.tails import f_sf, tukey_point
from ..functions.water import polynomial
from ..operators.joins import attach
from ..operators.ordered import ROWS_PER_TASK, numbered
from ..operators.quantiles import medians
from ..session import settle
from .regression import p_of_f


def cells(df: DataFrame, keys: Sequence[str], factors: Sequence[str], y: str) -> DataFrame:
    """n, mean and sum of squared deviations of each cell; rows with a NULL are left out."""
    used = df.dropna(subset=[*factors, y])
    return used.groupBy(*keys, *factors).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), (F.var_pop(y) * F.count(y)).alias("ss"))


def one_way(df: DataFrame, keys: Sequence[str], factor: str, y: str, p_value: bool = True) -> DataFrame:
    """One-way table in one row per key: df, SS, MS and F."""
    c = cells(df, keys, [factor], y)
    by = Window.partitionBy(*keys)
    grand = F.sum(F.col("n") * F.col("mean")).over(by) / F.sum("n").over(by)
    c = c.withColumn("between", F.col("n") * F.pow(F.col("mean") - grand, 2))
    out = c.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("df_factor"),
                               (F.sum("n") - F.count(F.lit(1))).alias("df_residual"),
                               F.sum("between").alias("ss_factor"), F.sum("ss").alias("ss_residual"))
    out = out.withColumns({"ms_factor": F.try_divide("ss_factor", "df_factor"),
                           "ms_residual": F.try_divide("ss_residual", "df_residual")})
    out = out.withColumn("f_value", F.try_divide("ms_factor", "ms_residual"))
    return out.withColumn("p", p_of_f("f_value", "df_factor", "df_residual")) if p_value else out


def _two_way_rows(n, mean, ss, a, b, names):
    """Sequential sums of squares from cell counts and means."""
    la, lb = sorted(set(a)), sorted(set(b))
    ia, ib = np.array([la.index(v) for v in a]), np.array([lb.index(v) for v in b])
    grand = np.sum(n * mean) / np.sum(n)
    y = mean - grand
    one = np.ones((len(n), 1))
    da = (ia[:, None] == np.arange(1, len(la))).astype(float)
    db = (ib[:, None] == np.arange(1, len(lb))).astype(float)
    inter = np.hstack([da[:, [i]] * db for i in range(da.shape[1])]) if da.shape[1] else np.zeros((len(n), 0))
    w = np.sqrt(n)

    def explained(x):
        # The rank counts what the present cells can tell apart; empty cells lower it.
        u, s, _ = np.linalg.svd(x * w[:, None], full_matrices=False)
        q = u[:, s > 1e-9 * s.max()]
        return float(np.sum((q.T @ (w * y)) ** 2)), q.shape[1]

    s0, r0 = explained(one)
    s1, r1 = explained(np.hstack([one, da]))
    s2, r2 = explained(np.hstack([one, da, db]))
    s3, r3 = explained(np.hstack([one, da, db, inter]))
    sums = np.array([s1 - s0, s2 - s1, s3 - s2, np.sum(ss) + (np.sum(n * y * y) - s3)])
    dfs = np.array([r1 - r0, r2 - r1, r3 - r2, np.sum(n) - r3], dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        ms = sums / dfs
        f = np.where(np.arange(4) < 3, ms / ms[3], np.nan)
    p = f_sf(f, dfs, np.full(4, dfs[3]))
    return pd.DataFrame({"source": [*names, " x ".join(names), "residual"], "df": dfs, "ss": sums,
                         "ms": ms, "f_value": f, "p": p})


def two_way(df: DataFrame, keys: Sequence[str], a: str, b: str, y: str, p_value: bool = True) -> DataFrame:
    """Two-way table with interaction, sequential sums of squares, any cell sizes."""
    keys = list(keys)
    c = cells(df, keys, [a, b], y)
    by = keys or ["_k"]
    c = c if keys else c.withColumn("_k", F.lit(1))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _two_way_rows(pdf["n"].to_numpy(float), pdf["mean"].to_numpy(float), pdf["ss"].to_numpy(float),
                            list(pdf[a]), list(pdf[b]), [a, b])
        for k in by[::-1]:
            out.insert(0, k, pdf[k].iloc[0])
        return out

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields if f.name in by)
    out = c.groupBy(*by).applyInPandas(table, f"{types}, source string, df double, ss double, ms double, "
                                              "f_value double, p double")
    # NaN marks "no test" inside numpy; tables carry NULL for it.
    out = out.withColumns({x: F.when(F.isnan(x), None).otherwise(F.col(x)) for x in ("ms", "f_value", "p")})
    out = out if keys else out.drop("_k")
    return out if p_value else out.drop("p")


def pairwise(df: DataFrame, keys: Sequence[str], factors: Sequence[str], y: str, p_value: bool = True) -> DataFrame:
    """All differences between cell means, adjusted for the number of cells.

    The pairs are pairs of cells of the table, the result itself; they do not
    grow with the rows.
    """
    c = cells(df, keys, factors, y).withColumn("cell", unite(factors, " "))
    c = settle(c)
    by = Window.partitionBy(*keys)
    c = c.withColumns({"k": F.count(F.lit(1)).over(by), "df": F.sum("n").over(by) - F.count(F.lit(1)).over(by),
                       "mse": F.try_divide(F.sum("ss").over(by), F.sum("n").over(by) - F.count(F.lit(1)).over(by))})
    one = [F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys]
    # Labels may collide ("a b" and "c", "a" and "b c"): the factors themselves tell cells apart.
    key = lambda s: F.struct(F.col(f"{s}.cell"), *[F.col(f"{s}.`{f}`") for f in factors])
    match = key("a") < key("b")
    for m in one:
        match = match & m
    if not keys:
        match = match & (F.col("a.k") == F.col("b.k"))
    se = F.sqrt(F.col("a.mse") * (1.0 / F.col("a.n") + 1.0 / F.col("b.n")))
    out = c.alias("a").join(c.alias("b"), match, "inner").select(
        *[F.col(f"a.`{k}`").alias(k) for k in keys], F.col("a.cell").alias("cell_1"),
        F.col("b.cell").alias("cell_2"), (F.col("a.mean") - F.col("b.mean")).alias("estimate"),
        se.alias("std_error"), F.col("a.df").alias("df"), F.col("a.k").alias("k"))
    out = out.withColumn("t_ratio", F.try_divide("estimate", "std_error"))
    if p_value:
        out = out.withColumn("_q", F.abs("t_ratio") * F.sqrt(F.lit(2.0)))
        out = range_tails(out, "_q", "k", "df", "p_adj").drop("_q")
    return out


def _letters(names: list, different: np.ndarray) -> list[str]:
    """Insert-and-absorb: levels that share a letter do not differ.

    Groups are bit sets. Level by level, a group that holds a level and some that
    differ from it is split into one without the level and one without those.
    """
    k = len(names)
    groups = {(1 << k) - 1}
    for i in range(k):
        others = sum(1 << int(j) for j in np.flatnonzero(different[i, i + 1:]) + i + 1)
        hit = {g for g in groups if g >> i & 1 and g & others}
        kept = groups - hit
        for g in sorted({h & ~(1 << i) for h in hit} | {h & ~others for h in hit}, key=int.bit_count, reverse=True):
            if not any(g & h == g for h in kept):
                kept.add(g)
        groups = kept
    members = sorted([i for i in range(k) if g >> i & 1] for g in groups)
    marks = [[] for _ in range(k)]
    for n, g in enumerate(members):
        for i in g:
            marks[i].append(ascii_letters[n] if n < len(ascii_letters) else f"({n + 1})")
    return ["".join(m) for m in marks]


def grouping_letters(df: DataFrame, keys: Sequence[str], factor: str, y: str, model: Sequence[str] = (),
                     alpha: float = 0.05) -> DataFrame:
    """Level means, best first, with letters; levels sharing one do not differ.

    The error comes from the cells of ``model`` (by default the factor alone). A
    task holds the levels of a key and their pairs, not their rows; one critical
    value decides all pairs. Letters go from a to z, A to Z, then numbers in
    brackets.
    """
    keys = list(keys)
    within = cells(df, keys, list(dict.fromkeys([factor, *model])), y)
    by = keys or ["_k"]
    within = within if keys else within.withColumn("_k", F.lit(1))

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        df_res = pdf["n"].sum() - len(pdf)
        mse = pdf["ss"].sum() / df_res if df_res > 0 else np.nan
        pdf = pdf.assign(total=pdf["n"] * pdf["mean"])
        g = pdf.groupby(factor, as_index=False)[["n", "total"]].sum()
        g["mean"] = g["total"] / g["n"]
        g = g.sort_values(["mean", factor], ascending=[False, True]).reset_index(drop=True)
        k = len(g)
        i, j = np.triu_indices(k, 1)
        m, n = g["mean"].to_numpy(), g["n"].to_numpy(float)
        q = np.abs(m[i] - m[j]) / np.sqrt(mse / 2.0 * (1.0 / n[i] + 1.0 / n[j]))
        different = np.zeros((k, k), dtype=bool)
        if k > 1:
            different[i, j] = q > tukey_point(alpha, k, df_res)
        out = pd.DataFrame({factor: g[factor], "n": g["n"].astype("int64"), "mean": m,
                            "letters": _letters(list(g[factor]), different)})
        for kk in by[::-1]:
            out.insert(0, kk, pdf[kk].iloc[0])
        return out

    types = {f.name: f.dataType.simpleString() for f in within.schema.fields}
    head = ", ".join(f"`{k}` {types[k]}" for k in by)
    out = within.groupBy(*by).applyInPandas(
        table, f"{head}, `{factor}` {types[factor]}, n long, mean double, letters string")
    return out if keys else out.drop("_k")


def levene(df: DataFrame, keys: Sequence[str], factors: Sequence[str], y: str, p_value: bool = True) -> DataFrame:
    """Equal-variance test: one-way table of distances from the cell medians."""
    used = df.select(*keys, *factors, y).dropna(subset=[*factors, y])
    middle = medians(used, [*keys, *factors], y)
    away = attach(used, middle, [*keys, *factors]).select(
        *keys, F.struct(*factors).alias("cell"), F.abs(F.col(y) - F.col("median")).alias("distance"))
    return one_way(away, keys, "cell", "distance", p_value)


def two_way_diagnostics(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """Fitted value, residual, leverage, standardised residual and Cook's distance.

    With the interaction in the model the fit of a row is the mean of its cell.
    """
    c = settle(cells(df, [], [a, b], y))
    p, rows, ss = c.agg(F.count(F.lit(1)), F.sum("n"), F.sum("ss")).first()
    mse = ss / (rows - p) if rows and rows > p else None
    out = attach(df.dropna(subset=[a, b, y]), c.select(a, b, "n", F.col("mean").alias("fitted")), [a, b])
    h = 1.0 / F.col("n")
    out = out.withColumns({"residual": F.col(y) - F.col("fitted"), "leverage": h})
    out = out.withColumn("std_residual", F.try_divide(
        F.col("residual"), F.sqrt(F.lit(mse).cast("double") * (1.0 - F.col("leverage")))))
    return out.withColumn("cooks_distance", F.try_divide(
        F.pow("std_residual", 2) * F.col("leverage"), (1.0 - F.col("leverage")) * F.lit(float(p)))).drop("n")


def _ranked(df: DataFrame, keys: Sequence[str], y: str, ties: Sequence[str],
            rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rank and group size; ties may be of any orderable type."""
    used = df.select(*keys, y, *ties).dropna(subset=[y])
    return numbered(used, keys, [y, *ties], name="i", total="n", rows_per_task=rows_per_task)


def qq_points(df: DataFrame, keys: Sequence[str], y: str, ties: Sequence[str] = ()) -> DataFrame:
    """Each value with its rank and the normal quantile of (i - 1/2) / n."""
    r = _ranked(df, keys, y, ties)
    return r.withColumn("theoretical", normal_quantile((F.col("i") - 0.5) / F.col("n"))).drop("n")


# Royston's polynomials for the two outer weights and for the p-value.
ROYSTON_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
ROYSTON_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
ROYSTON_GAMMA = (-2.273, 0.459)
ROYSTON_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
ROYSTON_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
ROYSTON_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
ROYSTON_LARGE_SD = (-0.4803, -0.082676, 0.0030302)


PUBLISHED_ROWS = 5000


def _shapiro(sums: DataFrame) -> DataFrame:
    """W and p from groups' sums: squared scores, scores times values, outer gaps.

    What is used again is a column of its own, which keeps the generated code small.
    """
    n, ss, e1 = F.when(F.col("n") >= 3, F.col("n").cast("double")), F.col("ss"), F.col("end1")
    sm2, smx, m1, m2, e2, a1, a2, w = (F.col(c) for c in ("sm2", "smx", "m1", "m2", "end2", "a1", "a2", "w"))
    out = sums.withColumn("root", 1.0 / F.sqrt(n))
    out = out.withColumns({"a1": F.try_divide(m1, F.sqrt(sm2)) + polynomial(F.col("root"), ROYSTON_LAST),
                           "a2": F.try_divide(m2, F.sqrt(sm2)) + polynomial(F.col("root"), ROYSTON_SECOND)})
    few = a1 * e1 + (smx - m1 * e1) / F.sqrt((sm2 - 2.0 * m1 * m1) / (1.0 - 2.0 * a1 * a1))
    many = a1 * e1 + a2 * e2 + (smx - m1 * e1 - m2 * e2) / F.sqrt(
        (sm2 - 2.0 * m1 * m1 - 2.0 * m2 * m2) / (1.0 - 2.0 * a1 * a1 - 2.0 * a2 * a2))
    out = out.withColumn("top", F.when(n == 3, F.lit(0.5 ** 0.5) * e1).when(n <= 5, few).when(n > 5, many))
    out = out.withColumn("w", F.when((n >= 3) & (ss > 0), F.least(F.lit(1.0), F.col("top") * F.col("top") / ss)))
    out = out.withColumns({"gap": F.when(w < 1.0, F.log1p(-w)).otherwise(float("-inf")), "size": F.log(n),
                           "edge": polynomial(n, ROYSTON_GAMMA)})
    gap, size, edge = F.col("gap"), F.col("size"), F.col("edge")
    small = F.when(gap < edge, (-F.log(edge - gap) - polynomial(n, ROYSTON_SMALL_MEAN))
                   / F.exp(polynomial(n, ROYSTON_SMALL_SD))).otherwise(float("inf"))
    large = (gap - polynomial(size, ROYSTON_LARGE_MEAN)) / F.exp(polynomial(size, ROYSTON_LARGE_SD))
    out = out.withColumn("score", F.when(n <= 11, small).otherwise(large))
    three = F.greatest(F.lit(0.0), 6.0 / math.pi * (F.asin(F.sqrt(w)) - math.asin(0.75 ** 0.5)))
    return out.withColumn("p", F.when(w.isNotNull(), F.when(n == 3, three).otherwise(normal_upper(F.col("score")))))


def shapiro_wilk(df: DataFrame, keys: Sequence[str], y: str, ties: Sequence[str] = ()) -> DataFrame:
    """Normality statistic W and its p-value per key.

    Both use all rows of any group. The p-value's polynomial in log n was published
    for up to 5000 rows and is used as it is beyond, where ``p_published`` is false.
    """
    r = _ranked(df, keys, y, ties)
    m = normal_quantile((F.col("i") - 0.375) / (F.col("n") + 0.25))
    v = F.col(y).cast("double")

    def at(i):
        return F.max(F.when(F.col("i") == i, F.col("v")))

    n = F.max("n")
    sums = r.withColumns({"m": m, "v": v}).groupBy(*keys).agg(
        n.alias("n"), (F.var_pop("v") * F.count("v")).alias("ss"), F.sum(F.col("m") * F.col("m")).alias("sm2"),
        F.sum(F.col("m") * F.col("v")).alias("smx"), F.max("m").alias("m1"),
        F.max(F.when(F.col("i") == F.col("n") - 1, F.col("m"))).alias("m2"),
        (F.max("v") - F.min("v")).alias("end1"),
        (F.max(F.when(F.col("i") == F.col("n") - 1, F.col("v"))) - at(2)).alias("end2"))
    return _shapiro(sums).select(*keys, "n", "w", "p", (F.col("n") <= PUBLISHED_ROWS).alias("p_published"))


def display_table(table: DataFrame, ids: Sequence[str], numbers: Sequence[str], p: str = "p",
                  f: str = "f_value", digits: int = 2) -> DataFrame:
    """Significant digits, dashes for missing tests, and marks behind the p-value.

    Marks follow the p-value as it is shown.
    """
    t = table.withColumns({c: signif(c, digits) for c in [*numbers, f, p]}).withColumn("star", stars(p))
    return t.select(*ids, *numbers, dash_if_null(f).alias(f),
                    unite([dash_if_null(p), "star"], " ", skip_null=True).alias(p))
