"""Random-intercept model y ~ x + (1 | cluster), fitted per key by REML.

The rows are summed per cluster, and clusters of one size are summed again: the
covariance of a cluster depends on its size only, so the likelihood at any
variance ratio is a sum over the few sizes that occur. All keys are fitted at
once: grids of ratios are crossed with the size classes, the sums decide which
part of the grid is cut finer, and so on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..session import settle
from .regression import p_of_f

# First grid of the variance ratio: powers of ten and points between them.
LOWEST, HIGHEST, STEPS = -8, 8, 160
# Each further level cuts a bracket into so many parts; a secant ends the last one.
CUTS, LEVELS = 64, 2
# Relative step of the numeric derivatives.
STEP = 1e-3


def size_classes(df: DataFrame, keys: Sequence[str], cluster: Sequence[str], x: str, y: str) -> DataFrame:
    """One row per (key, cluster size) with all sums the likelihood needs."""
    used = df.select(*keys, *cluster, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    used = used.dropna(subset=[*cluster, "x", "y"])
    c = used.groupBy(*keys, *cluster).agg(
        F.count(F.lit(1)).alias("size"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        (F.var_pop("x") * F.count("x")).alias("ssx"), (F.var_pop("y") * F.count("y")).alias("ssy"),
        (F.covar_pop("x", "y") * F.count("x")).alias("ssxy"))
    centre = used.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    c = attach(c, centre, keys)
    sx, sy = F.col("size") * (F.col("mx") - F.col("cx")), F.col("size") * (F.col("my") - F.col("cy"))
    c = c.withColumns({"sx": sx, "sy": sy})
    n = F.col("size")
    return c.groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("m"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"),
        F.sum(F.col("ssx") + F.col("sx") * F.col("sx") / n).alias("xx"),
        F.sum(F.col("ssxy") + F.col("sx") * F.col("sy") / n).alias("xy"),
        F.sum(F.col("ssy") + F.col("sy") * F.col("sy") / n).alias("yy"),
        F.sum(F.col("sx") * F.col("sx")).alias("sxsx"), F.sum(F.col("sx") * F.col("sy")).alias("sxsy"),
        F.sum(F.col("sy") * F.col("sy")).alias("sysy"))


def _fits(points: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row per key and point: the fit at the ratio ``theta``, summed over the size classes."""
    # Written as SQL text: one call each, where columns built by operators take thousands of calls to the JVM.
    rest, down = "(1 / (1 + theta * size))", "pow(1 + theta * size, -2)"
    s = points.groupBy("_key", "at").agg(
        F.max("theta").alias("theta"), *[F.max(x).alias(x) for x in carried], *[F.expr(x) for x in (
            "sum(m * size) AS rows", f"sum(m * size * {rest}) AS a00", f"sum(sx * {rest}) AS a01", f"sum(xx - theta * {rest} * sxsx) AS a11",
            f"sum(sy * {rest}) AS b0", f"sum(xy - theta * {rest} * sxsy) AS b1", f"sum(yy - theta * {rest} * sysy) AS c0",
            "sum(m * log1p(theta * size)) AS log_v", f"-sum(m * size * size * {down}) AS d00", f"-sum(sx * size * {down}) AS d01",
            f"-sum(sxsx * {down}) AS d11", f"-sum(sy * size * {down}) AS e0", f"-sum(sxsy * {down}) AS e1", f"-sum(sysy * {down}) AS g0")])
    s = s.selectExpr("*", "a00 * a11 - a01 * a01 AS det")
    s = s.selectExpr("*", "try_divide(a00 * b1 - a01 * b0, det) AS slope", "try_divide(a11 * b0 - a01 * b1, det) AS level",
                     "try_divide(a00, det) AS unit", "log_v + ln(det) AS log_det",
                     # The derivative of log_v is the sum of a00's weights.
                     "a00 + try_divide(a11 * d00 - 2 * a01 * d01 + a00 * d11, det) AS d_log_det")
    s = s.selectExpr("*", "c0 - level * b0 - slope * b1 AS q",
                     "g0 - 2 * (level * e0 + slope * e1) + level * level * d00 + 2 * level * slope * d01 + slope * slope * d11 AS dq")
    # The root of the derivative is sharper than the flat minimum.
    return s.selectExpr("_key", "at", "theta", *carried, "rows", "slope", "unit", "q", "log_det",
                        "(rows - 2) * ln(try_divide(greatest(q, 1e-300D), rows - 2)) + log_det AS profile",
                        "try_divide((rows - 2) * dq, q) + d_log_det AS gradient")


def _ratios(classes: DataFrame) -> DataFrame:
    """Per key: the log of the best positive ratio, ``best`` (0: none on the grid), and the criterion at 0."""
    power = LOWEST + (HIGHEST - LOWEST) * (F.col("at") - 1) / float(STEPS)
    grid = classes.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(STEPS + 1)))).withColumn(
        "theta", F.when(F.col("at") == 0, 0.0).otherwise(F.pow(F.lit(10.0), power)))
    width = math.log(10.0) * (HIGHEST - LOWEST) / STEPS
    bottom = math.log(10.0) * LOWEST

    def at_point(point: Column) -> Column:
        return bottom + width * (point - 1)
    found = _fits(grid).groupBy("_key").agg(F.coalesce(F.min_by("at", "profile"), F.lit(0)).alias("best"))
    found = found.withColumns({"low": at_point(F.greatest(F.col("best") - 1, F.lit(1))),
                               "high": at_point(F.least(F.col("best") + 1, F.lit(STEPS + 1)))})
    part = (F.col("high") - F.col("low")) / CUTS
    for _ in range(LEVELS):
        points = classes.join(found, "_key").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(CUTS)))).withColumn(
            "theta", F.exp(F.col("low") + part * F.col("at")))
        place = F.struct("at", "gradient")
        found = _fits(points, ["best", "low", "high"]).groupBy("_key").agg(
            F.min(F.when(F.col("gradient") >= 0, place)).alias("after"), F.max(F.when(F.col("gradient") < 0, place)).alias("before"),
            *[F.max(x).alias(x) for x in ("best", "low", "high")])
        # The bracket ends at the first point past the root; with none past it, at the upper end.
        stop = F.coalesce(F.col("after.at"), F.lit(CUTS))
        crossed = F.coalesce(F.col("before.at") == F.col("after.at") - 1, F.lit(False))
        share = F.when(crossed, F.try_divide("before.gradient", F.col("before.gradient") - F.col("after.gradient"))).otherwise(1.0)
        start = F.greatest(stop - 1, F.lit(0))
        found = found.select("_key", "best", (F.col("low") + part * start).alias("low"), (F.col("low") + part * stop).alias("high"),
                             (F.col("low") + part * (start + share * (stop - start))).alias("root"))
    return found.select("_key", "best", F.exp("root").alias("found"))


def _denominator_df() -> Column:
    """Satterthwaite degrees of freedom of the slope, from the fits just below, at and above the ratio."""
    s2, h = F.col("s2"), STEP * F.sqrt("found")
    hss = 4.0 * (F.col("rows") - 2.0) / s2
    hts = -(F.col("q_3") - F.col("q_1")) / h / F.pow(s2, F.lit(1.5))
    htt = (F.col("log_det_3") - 2.0 * F.col("log_det_2") + F.col("log_det_1")
           + (F.col("q_3") - 2.0 * F.col("q_2") + F.col("q_1")) / s2) / (h * h)
    gt = s2 * (F.col("unit_3") - F.col("unit_1")) / (2.0 * h)
    gs = 2.0 * F.sqrt(s2) * F.col("unit_2")
    det = htt * hss - hts * hts
    # A criterion flat in the ratio says nothing of it: the residual part is left.
    spread = F.when(det > 1e-8 * F.abs(htt * hss), (gt * gt * hss - 2.0 * gt * gs * hts + gs * gs * htt) / det).otherwise(gs * gs / hss)
    return F.try_divide(F.pow(s2 * F.col("unit_2"), F.lit(2.0)), spread)


def random_intercept(df: DataFrame, keys: Sequence[str], cluster: Sequence[str], x: str, y: str) -> DataFrame:
    """Test of the slope of x with a random intercept per cluster, all keys in one job.

    One row per key: estimate, variance ratio, residual variance, SS, MS, both
    degrees of freedom (Satterthwaite), F, p, and ``at_limit``: the ratio lies at
    the end of the searched range. A key whose x does not vary, or with two rows
    or fewer, has NULL for all that can't be estimated.
    """
    keys = list(keys)
    by = keys or ["_k"]
    sums = size_classes(df if keys else df.withColumn("_k", F.lit(1)), by, cluster, x, y)
    # A struct of keys equals itself even where a key is NULL.
    classes = settle(sums.select(F.struct(*by).alias("_key"), *[c for c in sums.columns if c not in by]))
    found = _ratios(classes)
    tau = F.sqrt("found") * (1.0 + STEP * (F.col("at") - 2))
    points = classes.join(found, "_key").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "theta", F.when(F.col("at") == 0, 0.0).otherwise(tau * tau))
    fits = _fits(points, ["best", "found"])
    wide = fits.groupBy("_key").agg(
        *[F.max(c).alias(c) for c in ("best", "found", "rows")],
        *[F.max(F.when(F.col("at") == i, F.col(c))).alias(f"{c}_{i}")
          for i in range(4) for c in ("slope", "unit", "q", "log_det", "profile")])
    positive = F.coalesce((F.col("best") > 0) & (F.col("profile_2") < F.col("profile_0") - 1e-10), F.lit(False))

    def chosen(c: str) -> Column:
        return F.when(F.col("positive"), F.col(f"{c}_2")).otherwise(F.col(f"{c}_0"))
    wide = wide.withColumn("positive", positive)
    wide = wide.withColumns({"estimate": chosen("slope"), "unit": chosen("unit"),
                             "s2": F.when(F.col("rows") > 2, F.try_divide(chosen("q"), F.col("rows") - 2.0))})
    wide = wide.withColumns({"f": F.try_divide(F.col("estimate") * F.col("estimate"), F.col("s2") * F.col("unit")),
                             "den": F.when(F.col("positive"), _denominator_df()).otherwise(F.col("rows") - 2.0)})
    ss = F.col("f") * F.col("s2")
    out = wide.select(
        *[F.col("_key").getField(k).alias(k) for k in keys], "estimate",
        F.when(F.col("positive"), F.col("found")).otherwise(0.0).alias("ratio"), F.col("s2").alias("residual_variance"),
        ss.alias("ss"), ss.alias("ms"), F.lit(1.0).alias("num_df"), F.col("den").cast("double").alias("den_df"),
        F.col("f").alias("f_value"), p_of_f("f", F.lit(1.0), F.col("den").cast("double")).alias("p"),
        (F.col("positive") & (F.col("best") == STEPS + 1)).alias("at_limit"))
    return out.withColumn("p", F.when(~F.isnan("p"), F.col("p")))
