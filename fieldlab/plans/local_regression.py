"""Ranked local regression (Olito et al. 2017): the most linear part of a series."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tails import t975_by_points
from ..operators.joins import natural_join
from ..session import settle, small_side
from .long_series import rank_long_series

# A series of this many thinned points is ranked inside one task.
SERIES_POINTS = 4096

RESULT = "start_row long, stop_row long, intercept double, slope double, score double"


def moments(x: np.ndarray, y: np.ndarray, x_before: float = 0.0, y_before: float = 0.0) -> np.ndarray:
    """Rows whose running sums give every window's fit and residual moments.

    The last four are products with the point before.
    """
    px, py = np.concatenate([[x_before], x[:-1]]), np.concatenate([[y_before], y[:-1]])
    return np.stack([np.ones_like(x), x, y, x * x, x * y, y * y, x ** 3, x * x * y, x * y * y, y ** 3,
                     x * px, x * py, y * px, y * py])


def window_measures(s: np.ndarray, first: tuple, last: tuple, before: np.ndarray, t975: np.ndarray):
    """Slope, intercept and the three badness measures of many windows.

    ``s`` holds the window sums of ``moments``; ``first`` and ``last`` are the
    (x, y) of the end points, ``before`` the lag products at the first point,
    which do not belong to the window.
    """
    n, sx, sy, sxx, sxy, syy, sxxx, sxxy, sxyy, syyy, lxx, lxy, lyx, lyy = s
    lxx, lxy, lyx, lyy = lxx - before[0], lxy - before[1], lyx - before[2], lyy - before[3]
    mx, my = sx / n, sy / n
    cxx, cxy, cyy = sxx - sx * mx, sxy - sx * my, syy - sy * my
    slope = cxy / cxx
    level = my - slope * mx
    rss = np.maximum(cyy - slope * cxy, 0.0)
    width = 2.0 * t975 * np.sqrt(rss / (n - 2.0) / cxx)
    # Third moment of y - level - slope x, expanded in the sums.
    a, b = level, slope
    third = (syyy - n * a ** 3 - b ** 3 * sxxx - 3 * a * syy - 3 * b * sxyy + 3 * a * a * sy
             + 3 * b * b * sxxy - 3 * a * a * b * sx - 3 * a * b * b * sxx + 6 * a * b * sxy)
    with np.errstate(divide="ignore", invalid="ignore"):
        skew = np.abs(np.where(rss > 0, (third / n) / (rss / n) ** 1.5, 0.0))
    # First-order serial correlation: residuals on x and the residual before.
    x1, y1 = first
    xn, yn = last
    en = yn - a - b * xn
    later, earlier = (sx - x1, sy - y1), (sx - xn, sy - yn)
    ee = (lyy - a * (earlier[1] + later[1]) + a * a * (n - 1) + a * b * (earlier[0] + later[0])
          - b * (lyx + lxy) + b * b * lxx)
    zz = rss - en * en
    z1 = -en
    zx = lxy - a * later[0] - b * lxx
    zm = zz - z1 * z1 / n - (zx - z1 * mx) ** 2 / cxx
    with np.errstate(divide="ignore", invalid="ignore"):
        serial = np.where((zm > 0) & (rss > 0), ee * ee / (zm * rss), 0.0)
    return slope, level, skew, serial, width


def whole_rank(v: np.ndarray) -> np.ndarray:
    """Whole part of the average rank."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.flatnonzero(new)
    end = np.concatenate([start[1:], [len(s)]])
    mean_rank = (start + 1 + end) / 2.0
    out = np.empty(len(v))
    out[order] = np.floor(mean_rank[np.cumsum(new) - 1])
    return out


def best_window(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple:
    """First and last index, intercept, slope and score of the best window."""
    n = len(x)
    shortest = max(3, int(np.floor(alpha * n)))
    if n < shortest or n < 3:
        return (None,) * 5
    mx, my = x.mean(), y.mean()
    cx = x - mx
    spread = np.sum(cx * cx)
    base = float(np.sum(cx * (y - my)) / spread) if spread > 0 else 0.0
    r = y - my - base * cx
    m = moments(cx, r)
    total = np.concatenate([np.zeros((m.shape[0], 1)), np.cumsum(m, axis=1)], axis=1)
    i, j = np.triu_indices(n, shortest - 1)
    t975 = t975_by_points(1 << int(n).bit_length())
    parts = []
    for a in range(0, len(i), 1 << 18):
        p, q = i[a:a + (1 << 18)], j[a:a + (1 << 18)]
        parts.append(window_measures(total[:, q + 1] - total[:, p], (cx[p], r[p]), (cx[q], r[q]),
                                     m[10:, p], t975[q - p + 1]))
    slope, level, skew, serial, width = (np.concatenate(v) for v in zip(*parts))
    # Whole ranks add up exactly, so equal scores are equal and the first window wins.
    ranks = whole_rank(skew) + whole_rank(serial) + whole_rank(width)
    k = int(np.argmin(ranks))
    # The local line is level + slope (x - mx) on top of my + base (x - mx).
    b = slope[k] + base
    return int(i[k]), int(j[k]), float(level[k] + my - b * mx), float(b), float(ranks[k] / len(ranks) / 3.0)


def ranked_local_regression(series: DataFrame, file: str, x: str, y: str, alpha: float = 0.5,
                            mean_of: str | None = None, series_points: int = SERIES_POINTS, **long) -> DataFrame:
    """Best local line of each file: all windows of at least alpha n points are
    ranked by residual skewness, serial correlation and width of the slope's
    confidence interval; the smallest mean rank wins.

    ``mean_of`` adds the mean of one more column over the points used. Files of
    up to ``series_points`` points are ranked in one task each; longer ones are
    spread over tasks with the same result.
    """
    spark = series.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in series.schema.fields}[file]
    extra = F.col(mean_of).cast("double") if mean_of else F.lit(None).cast("double")
    pts = settle(series.select(file, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                               extra.alias("extra")).dropna(subset=["x", "y"]))
    sizes = pts.groupBy(file).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("base"), F.avg("extra").alias("mean_extra"))
    large = settle(sizes.filter(F.col("n") > series_points))
    any_large = large.limit(1).count() > 0

    def rank(table: pa.Table) -> pa.Table:
        t = table.sort_by([("x", "ascending"), ("y", "ascending")])
        row = best_window(t["x"].to_numpy(), t["y"].to_numpy(), alpha)
        return pa.table({file: table[file].slice(0, 1), "start_row": pa.array([row[0]], pa.int64()),
                         "stop_row": pa.array([row[1]], pa.int64()),
                         **{n: pa.array([v], pa.float64()) for n, v in zip(("intercept", "slope", "score"), row[2:])},
                         "mean_extra": pa.array([pc.mean(table["extra"]).as_py()], pa.float64())})

    usual = natural_join(pts, small_side(large.select(file)), "left_anti", [file]) if any_large else pts
    # The ranking is heavy on the processor and light on bytes, so the number of
    # tasks is set here and not left to merging by size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    out = usual.repartition(tasks, file).groupBy(file).applyInArrow(rank, f"`{file}` {kind}, {RESULT}, mean_extra double")
    if any_large:
        far = natural_join(pts, small_side(large.select(file)), "left_semi", [file])
        fits = rank_long_series(far, large.drop("mean_extra"), file, kind, alpha, **long)
        out = out.unionByName(natural_join(fits, large.select(file, "mean_extra"), "inner", [file]))
    return out.withColumnRenamed("mean_extra", f"mean_{mean_of}") if mean_of else out.drop("mean_extra")
