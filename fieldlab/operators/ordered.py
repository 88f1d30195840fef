"""Ordered operators that hold when one series has a third of all rows.

A plain window sends a whole series to one task. That is right for the many
series of ordinary length. Rows of series counted to be longer than a bound are
dealt by sampled range bounds over (key, order, salt), so any orderable columns
will do, and rows crowded on one instant with one tie are still cut by the salt.
A second level then scans the slices: their sizes and sums are a small table,
its running totals are the slices' starts, and rows are numbered inside their
slice only. A NULL key counts as a series of its own; NULLs come first in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle
from .joins import attach

# A series of more rows than this is sliced; slices aim at half of it, which
# leaves room for what sampled bounds are off.
ROWS_PER_TASK = 1_000_000


def _sliced(df: DataFrame, keys: list[str], order: list[str], hot: DataFrame, rows_per_task: int) -> DataFrame:
    """Rows with their ``slice``: ranges of the order for long series, -1 for all others.

    The ranges are written once, so both readers of a slice see the same rows;
    rows that are equal in all order columns are told apart by the salt.
    """
    rows = attach(df, hot, keys)
    parts = -(-2 * hot.agg(F.sum("hot_n")).first()[0] // rows_per_task)
    long = rows.filter(F.col("hot_n").isNotNull()).withColumn("salt", F.monotonically_increasing_id())
    dealt = long.repartitionByRange(parts, *keys, *order, "salt").withColumn("slice", F.spark_partition_id())
    dealt = settle(dealt.select(*df.columns, "slice"))
    return rows.filter(F.col("hot_n").isNull()).select(*df.columns, F.lit(-1).alias("slice")).unionByName(dealt)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n", total: str | None = None,
             running: str | Mapping[str, str] | None = None, running_name: str = "running", ends: str | None = None,
             measure: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Row number in each series and, if asked, series length and running sums.

    ``order`` names columns of any orderable type; rows equal in all of them are
    numbered in no certain order. ``running`` is a column to add up as
    ``running_name``, or a mapping of new names to columns. ``ends`` adds the
    series' first and last value of a column as ``first_value`` and
    ``last_value``. ``measure`` is a table whose rows bound those of ``df``, to
    find long series without computing ``df`` once more.
    """
    keys, order = list(keys), list(order)
    sums = {running_name: running} if isinstance(running, str) else dict(running or {})
    source = df if measure is None else measure
    hot = settle(source.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_n")).filter(F.col("hot_n") > rows_per_task))
    carried = ([total] if total else []) + (["first_value", "last_value"] if ends else [])
    keep = [*df.columns, name, *carried, *sums]

    if hot.limit(1).count() == 0:
        series = Window.partitionBy(*keys)
        upto = series.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = series.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        made = {name: F.row_number().over(series.orderBy(*order)).cast("long")}
        if total:
            made[total] = F.count(F.lit(1)).over(whole)
        if ends:
            made.update(first_value=F.first(ends).over(whole), last_value=F.last(ends).over(whole))
        made.update({s: F.coalesce(F.sum(c).over(upto), F.lit(0)) for s, c in sums.items()})
        return df.withColumns(made).select(*keep)

    cut = _sliced(df, keys, order, hot, rows_per_task)
    sizes = [F.count(F.lit(1)).alias("slice_rows"), *[F.sum(c).alias(f"slice_sum_{s}") for s, c in sums.items()]]
    if ends:
        sizes += [F.min_by(ends, F.struct(*order)).alias("slice_first"),
                  F.max_by(ends, F.struct(*order)).alias("slice_last")]
    per_slice = cut.groupBy(*keys, "slice").agg(*sizes)
    series = Window.partitionBy(*keys)
    before = series.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = {"rows_before": F.coalesce(F.sum("slice_rows").over(before), F.lit(0))}
    if total:
        starts[total] = F.sum("slice_rows").over(series)
    if ends:
        starts["first_value"] = F.min_by("slice_first", "slice").over(series)
        starts["last_value"] = F.max_by("slice_last", "slice").over(series)
    starts.update({f"before_{s}": F.coalesce(F.sum(f"slice_sum_{s}").over(before), F.lit(0)) for s in sums})
    offsets = per_slice.withColumns(starts).drop("slice_rows", *[f"slice_sum_{s}" for s in sums], "slice_first", "slice_last")

    # Each slice's start travels as one row ahead of the rows of that slice, so
    # the same window adds it in and no join is needed.
    step = {"is_start": F.lit(0), "step": F.lit(1).cast("long"), **{f"add_{s}": F.col(c) for s, c in sums.items()}}
    start = {"is_start": F.lit(1), "step": F.col("rows_before").cast("long"),
             **{f"add_{s}": F.col(f"before_{s}") for s in sums}}
    rows = cut.withColumns(step).unionByName(
        offsets.withColumns(start).drop("rows_before", *[f"before_{s}" for s in sums]), allowMissingColumns=True)
    inside = (Window.partitionBy(*keys, "slice").orderBy(F.desc("is_start"), *order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    made = {name: F.sum("step").over(inside), **{s: F.sum(f"add_{s}").over(inside) for s in sums}}
    made.update({c: F.first(c).over(inside) for c in carried})
    return rows.withColumns(made).filter(F.col("is_start") == 0).select(*keep)


def skip_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """Drop the first k rows of each series.

    Only k rows per key and map task reach the ranking (Spark limits each group
    before the exchange); their largest order value is the cut-off.
    """
    if k <= 0:
        return df
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    head = df.select(*keys, *[c for c in order if c not in keys]).withColumn("rank", rank).filter(F.col("rank") <= k)
    cutoff = head.groupBy(*keys).agg(F.max(F.struct(*order)).alias("cutoff"))
    return (attach(df, cutoff, keys, "inner", many=True)
            .filter(F.struct(*order) > F.col("cutoff")).drop("cutoff"))


def every_kth(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int,
              name: str = "n", **sizes) -> DataFrame:
    """Keep rows k, 2k, 3k ... of each series, with their number."""
    return numbered(df, keys, order, name=name, **sizes).filter(F.col(name) % k == 0)


def first_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """First value, last value and length of each series, by plain aggregates."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(value, at).alias("first_value"),
                                 F.max_by(value, at).alias("last_value"),
                                 F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows of each group; groups are cut to k before the exchange."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def nth_record(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str,
               ns: Sequence[int], prefix: str = "record") -> DataFrame:
    """The n-th record of each key as columns, NULL where a key has fewer."""
    top = top_k(df, keys, order, max(ns))
    return top.groupBy(*keys).agg(*[
        F.max(F.when(F.col("rank") == n, F.col(value))).alias(f"{prefix}_{n}") for n in ns])


def pair_numbers(df: DataFrame, group: Sequence[str], pair: Sequence[str], name: str = "pair_no") -> DataFrame:
    """Dense number of each pair inside its group, on the distinct pairs only."""
    pairs = df.select(*group, *pair).distinct()
    w = Window.partitionBy(*group).orderBy(*pair)
    return pairs.withColumn(name, F.row_number().over(w))
