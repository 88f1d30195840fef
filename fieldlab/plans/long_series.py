"""Ranked local regression of a series too long for one task.

The windows of a long series are never written out. A series is cut into blocks
of consecutive points; a task meets one pair of blocks, forms the windows that
start in the first and end in the second, and returns counts only. The counts
bound every window's rank from both sides. Windows whose best possible score
lies above another's worst possible score are out; bins are refined around the
rest until few are left, and those get their exact ranks from one more count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tails import t975_by_points
from ..operators.joins import attach
from ..operators.ordered import numbered
from ..session import settle

BLOCK = 512
CANDIDATES = 4000
ROUNDS = 12
MEASURES = (0, 1, 2)
# Even steps in the logarithm, the same for every file.
FIRST_EDGES = [float(v) for v in np.logspace(-60, 60, 1201, base=2.0)]


def _pair_windows(row, moments, window_measures):
    """All windows from a start block to an end block, as arrays."""
    xa, ra, xc, rc = (np.asarray(row[k], float) for k in ("xa", "ra", "xc", "rc"))
    ma = moments(xa, ra, row["pxa"], row["pra"])
    mc = moments(xc, rc, row["pxc"], row["prc"])
    below = np.asarray(row["sa"], float)[:, None] + np.cumsum(ma, axis=1) - ma
    upto = np.asarray(row["sc"], float)[:, None] + np.cumsum(mc, axis=1)
    i0, j0 = int(row["block_a"]) * row["size"], int(row["block_c"]) * row["size"]
    p, q = np.nonzero((np.arange(len(xc))[None, :] + j0) - (np.arange(len(xa))[:, None] + i0) + 1 >= row["shortest"])
    if len(p) == 0:
        return None
    t975 = t975_by_points(1 << int(row["n"]).bit_length())[(q + j0) - (p + i0) + 1]
    slope, level, skew, serial, width = window_measures(
        upto[:, q] - below[:, p], (xa[p], ra[p]), (xc[q], rc[q]), ma[10:, p], t975)
    return p + i0, q + j0, slope, level, (skew, serial, width)


def _bins(v, edges):
    """Even numbers lie between two edges, odd ones on an edge."""
    return np.searchsorted(edges, v, "left") + np.searchsorted(edges, v, "right")


def _rank_bounds(row, values):
    """Smallest and largest mean rank of each window, as shares of all windows."""
    low, high = 0.0, 0.0
    for m in MEASURES:
        b = _bins(values[m], np.asarray(row[f"edges_{m}"], float))
        table = row[f"ranks_{m}"]
        bins = np.array([r["bin"] for r in table])
        before = np.array([r["before"] for r in table], float)
        count = np.array([r["c"] for r in table], float)
        at = np.searchsorted(bins, b)
        exact = b % 2 == 1
        middle = np.floor(before[at] + (count[at] + 1) / 2.0)
        low = low + np.where(exact, middle, before[at] + 1)
        high = high + np.where(exact, middle, before[at] + count[at])
    return low / row["windows"] / 3.0, high / row["windows"] / 3.0


def rank_long_series(pts: DataFrame, sizes: DataFrame, file: str, kind: str, alpha: float,
                     block: int = BLOCK, candidates: int = CANDIDATES) -> DataFrame:
    """Best window of each file; ``sizes`` has a row per file: n, mx, my, base."""
    from .local_regression import moments, window_measures

    sizes = sizes.withColumn("shortest", F.greatest(F.lit(3), F.floor(F.lit(alpha) * F.col("n"))).cast("long"))
    sizes = sizes.withColumn("windows", (F.col("n") - F.col("shortest") + 1) * (F.col("n") - F.col("shortest") + 2) / 2)
    idx = attach(numbered(pts.select(file, "x", "y"), [file], ["x", "y"], name="i"), sizes, [file])
    gap = F.col("x") - F.col("mx")
    rows = idx.select(file, (F.col("i") - 1).alias("i"), gap.alias("x"),
                      (F.col("y") - F.col("my") - F.col("base") * gap).alias("r"))
    blocks = (rows.groupBy(file, F.floor(F.col("i") / block).cast("long").alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("i", "x", "r"))).alias("p"))
              .select(file, "block", F.col("p.x").alias("x"), F.col("p.r").alias("r")))
    blocks = settle(blocks)
    ends = blocks.select(file, (F.col("block") + 1).alias("block"), F.element_at("x", -1).alias("px"),
                         F.element_at("r", -1).alias("pr"))
    blocks = attach(blocks, ends, [file, "block"], many=True).na.fill(0.0, ["px", "pr"])

    def totals(batches):
        for pdf in batches:
            s = [moments(np.asarray(x, float), np.asarray(r, float), px, pr).sum(axis=1)
                 for x, r, px, pr in zip(pdf["x"], pdf["r"], pdf["px"], pdf["pr"])]
            out = pdf[[file, "block"]].copy()
            for k in range(14):
                out[f"s{k}"] = [v[k] for v in s]
            yield out

    sums = blocks.mapInPandas(totals, f"`{file}` {kind}, block long, " + ", ".join(f"s{k} double" for k in range(14)))
    before = Window.partitionBy(file).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(file, "block", F.array(*[
        F.coalesce(F.sum(f"s{k}").over(before), F.lit(0.0)) for k in range(14)]).alias("s"))
    ready = settle(attach(blocks, starts, [file, "block"], "inner", many=True))

    a = attach(ready, sizes.select(file, "n", "shortest", "windows"), [file]).select(
        file, "n", "shortest", "windows", F.lit(block).alias("size"), F.col("block").alias("block_a"), F.col("x").alias("xa"),
        F.col("r").alias("ra"), F.col("px").alias("pxa"), F.col("pr").alias("pra"), F.col("s").alias("sa"))
    last = F.floor((F.col("n") - 1) / block).cast("long")
    nearest = F.floor((F.col("block_a") * block + F.col("shortest") - 1) / block).cast("long")
    a = a.filter(nearest <= last).withColumn("block_c", F.explode(F.sequence(nearest, last)))
    c = ready.select(file, F.col("block").alias("block_c"), F.col("x").alias("xc"), F.col("r").alias("rc"),
                     F.col("px").alias("pxc"), F.col("pr").alias("prc"), F.col("s").alias("sc"))
    # Few bytes and much work per pair: the number of tasks is set, not merged by size.
    spark = pts.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = settle(attach(a, c, [file, "block_c"], "inner", many=True).repartition(tasks, file, "block_a", "block_c"))

    def per_pair(f, schema, *tables):
        """Run ``f(row, windows)`` on every pair, with per-file tables joined in."""
        source = pairs
        for t in tables:
            source = attach(source, t, [file], "inner")

        def run(batches):
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    w = _pair_windows(row, moments, window_measures)
                    if w is not None:
                        out = f(row, w)
                        if out is not None and len(out):
                            out.insert(0, file, row[file])
                            yield out
        return source.mapInPandas(run, f"`{file}` {kind}, {schema}")

    def count(row, w):
        parts = []
        for m in MEASURES:
            b, n = np.unique(_bins(w[4][m], np.asarray(row[f"edges_{m}"], float)), return_counts=True)
            parts.append(pd.DataFrame({"m": m, "bin": b, "c": n}))
        return pd.concat(parts)

    def ranks(edges):
        n = per_pair(count, "m int, bin long, c long", edges).groupBy(file, "m", "bin").agg(F.sum("c").alias("c"))
        w = Window.partitionBy(file, "m").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = n.withColumn("before", F.sum("c").over(w) - F.col("c"))
        return settle(n.groupBy(file).agg(*[
            F.sort_array(F.collect_list(F.when(F.col("m") == m, F.struct("bin", "before", "c")))).alias(f"ranks_{m}")
            for m in MEASURES]))

    def bound(edges, table):
        def worst(row, w):
            return pd.DataFrame({"bound": [float(_rank_bounds(row, w[4])[1].min())]})
        return settle(per_pair(worst, "bound double", edges, table).groupBy(file).agg(F.min("bound").alias("bound")))

    def left(row, w):
        low, _ = _rank_bounds(row, w[4])
        return low, low <= row["bound"] + 1e-12

    def survey(row, w):
        _, keep = left(row, w)
        if not keep.any():
            return None
        at = np.linspace(0.0, 1.0, 65)
        values = [np.quantile(w[4][m][keep], at, method="nearest") for m in MEASURES]
        return pd.DataFrame({"left": [int(keep.sum())], **{f"v_{m}": [values[m]] for m in MEASURES}})

    def chosen(row, w):
        low, keep = left(row, w)
        return pd.DataFrame({"start_row": w[0][keep], "stop_row": w[1][keep], "level": w[3][keep], "slope": w[2][keep],
                             "score": low[keep], **{f"v_{m}": w[4][m][keep] for m in MEASURES}})

    def joined(edges, more):
        both = attach(edges, more, [file], "inner")
        return settle(both.select(file, *[F.array_sort(F.array_distinct(F.concat(f"edges_{m}", f"more_{m}"))).alias(f"edges_{m}")
                                          for m in MEASURES]))

    chosen_schema = ("start_row long, stop_row long, level double, slope double, score double, "
                     + ", ".join(f"v_{m} double" for m in MEASURES))
    first = F.array(*[F.lit(v) for v in FIRST_EDGES])
    edges = settle(sizes.select(file, *[first.alias(f"edges_{m}") for m in MEASURES]))
    for _ in range(ROUNDS):
        table = ranks(edges)
        limit = bound(edges, table)
        found = settle(per_pair(survey, "left long, " + ", ".join(f"v_{m} array<double>" for m in MEASURES),
                                edges, table, limit))
        if found.groupBy(file).agg(F.sum("left").alias("n")).agg(F.max("n")).first()[0] <= candidates:
            break
        cuts = [i / 2000.0 for i in range(2001)]
        more = [found.select(file, F.explode(f"v_{m}").alias("v")).groupBy(file).agg(
            F.percentile_approx("v", cuts, 10000).alias(f"more_{m}")) for m in MEASURES]
        edges = joined(edges, attach(attach(more[0], more[1], [file]), more[2], [file]))
    exact = per_pair(chosen, chosen_schema, edges, table, limit).groupBy(file).agg(
        *[F.collect_set(f"v_{m}").alias(f"more_{m}") for m in MEASURES])
    edges = joined(edges, exact)
    table = ranks(edges)
    best = per_pair(chosen, chosen_schema, edges, table, bound(edges, table)).groupBy(file).agg(
        F.min(F.struct("score", "start_row", "stop_row", "level", "slope")).alias("w"))
    out = attach(best, sizes, [file])
    slope = F.col("w.slope") + F.col("base")
    return out.select(file, F.col("w.start_row").alias("start_row"), F.col("w.stop_row").alias("stop_row"),
                      (F.col("w.level") + F.col("my") - slope * F.col("mx")).alias("intercept"),
                      slope.alias("slope"), F.col("w.score").alias("score"))
