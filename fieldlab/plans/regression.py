"""Straight-line and small linear models from summed cross-products."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tails import f_sf, t_quantile, t_sf2


@F.pandas_udf(T.DoubleType())
def p_of_f(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper F tail for summary rows."""
    return pd.Series(f_sf(f.to_numpy(float), df1.to_numpy(float), df2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def p_of_t(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided t tail for summary rows."""
    return pd.Series(t_sf2(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_at(p: pd.Series, df: pd.Series) -> pd.Series:
    """Student quantile for summary rows."""
    return pd.Series(t_quantile(p.to_numpy(float), df.to_numpy(float)))


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, p_value: bool = False) -> DataFrame:
    """Least-squares line per key with R2, standard errors and t values."""
    fit = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_avgx(y, x).alias("mean_x"))
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx"))
    fit = fit.withColumn("mse", F.try_divide(rss, F.col("n") - 2))
    fit = fit.withColumns({
        "se_slope": F.sqrt(F.try_divide(F.col("mse"), F.col("sxx"))),
        "se_intercept": F.sqrt(F.col("mse") * (1.0 / F.col("n") + F.try_divide(
            F.col("mean_x") * F.col("mean_x"), F.col("sxx"))))})
    fit = fit.withColumns({"t_slope": F.try_divide("slope", "se_slope"),
                           "t_intercept": F.try_divide("intercept", "se_intercept")})
    if p_value:
        fit = fit.withColumns({"p_slope": p_of_t("t_slope", F.col("n") - 2),
                               "p_intercept": p_of_t("t_intercept", F.col("n") - 2)})
    return fit


def line_band(df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 80,
              level: float = 0.95) -> DataFrame:
    """Fitted line and confidence band on an even grid over each key's x range."""
    fit = line_fit(df, keys, x, y)
    ends = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    from ..operators.joins import natural_join
    g = natural_join(fit, ends, "inner", list(keys))
    g = g.withColumn("tq", t_at(F.lit((1.0 + level) / 2.0), F.col("n") - 2))
    g = g.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("grid") / F.lit(points - 1)
    g = g.withColumn("x", at).withColumn("fit", F.col("intercept") + F.col("slope") * F.col("x"))
    gap = F.col("x") - F.col("mean_x")
    half = F.col("tq") * F.sqrt(F.col("mse") * (1.0 / F.col("n") + F.try_divide(gap * gap, F.col("sxx"))))
    return g.select(*keys, "grid", "x", "fit", (F.col("fit") - half).alias("low"), (F.col("fit") + half).alias("high"))


def linear_model(df: DataFrame, keys: Sequence[str], y: str | Column, terms: dict[str, Column],
                 p_value: bool = True) -> DataFrame:
    """Coefficient table of y on named terms plus an intercept, per key.

    One pass sums the centred cross-products (Spark's covariances are updated
    stably), so only one row per key reaches the solve.
    """
    keys = list(keys)
    names = list(terms)
    data = df.select(*keys, (F.col(y) if isinstance(y, str) else y).cast("double").alias("_y"),
                     *[c.cast("double").alias(n) for n, c in terms.items()]).dropna(subset=["_y", *names])
    cols = ["_y", *names]
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    aggs += [F.avg(c).alias(f"mean_{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_pop(cols[i], cols[j]).alias(f"cov_{i}_{j}")
             for i in range(len(cols)) for j in range(i, len(cols))]
    one = data.withColumn("_k", F.lit(1)) if not keys else data
    by = keys or ["_k"]
    summary = one.groupBy(*by).agg(*aggs)
    p = len(names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        n = row["n"]
        cov = np.zeros((p + 1, p + 1))
        for i in range(p + 1):
            for j in range(i, p + 1):
                cov[i, j] = cov[j, i] = row[f"cov_{i}_{j}"] * n
        mean = np.array([row[f"mean_{i}"] for i in range(p + 1)])
        sxx, sxy, syy = cov[1:, 1:], cov[1:, 0], cov[0, 0]
        inv = np.linalg.pinv(sxx)
        beta = inv @ sxy
        rss = max(0.0, syy - beta @ sxy)
        df_res = n - p - 1
        mse = rss / df_res if df_res > 0 else np.nan
        est = np.concatenate([[mean[0] - mean[1:] @ beta], beta])
        var = np.concatenate([[mse * (1.0 / n + mean[1:] @ inv @ mean[1:])], mse * np.diag(inv)])
        se = np.sqrt(var)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = est / se
        out = pd.DataFrame({"term": ["intercept", *names], "estimate": est, "std_error": se, "t": t,
                            "p": t_sf2(t, np.full(p + 1, df_res)), "df": df_res,
                            "r2": 1.0 - rss / syy if syy > 0 else np.nan})
        for k in by[::-1]:
            out.insert(0, k, row[k])
        return out

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summary.schema.fields if f.name in by)
    out = summary.groupBy(*by).applyInPandas(
        solve, f"{types}, term string, estimate double, std_error double, t double, p double, df double, r2 double")
    out = out if keys else out.drop("_k")
    return out if p_value else out.drop("p")
