"""Joins: null-safe natural joins, interval joins, exclusion windows, lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import seconds
from ..session import BROADCAST_ROWS, settle, small_side


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Names in both tables; names that differ only in case are refused."""
    lower = {c.lower(): c for c in left.columns}
    for c in right.columns:
        if c.lower() in lower and lower[c.lower()] != c:
            raise ValueError(f"names differ only in case: {lower[c.lower()]}, {c}")
    return [c for c in left.columns if c in set(right.columns)]


def natural_join(left: DataFrame, right: DataFrame, how: str = "left",
                 on: Sequence[str] | None = None, suffixes: tuple[str, str] = ("", "_right")) -> DataFrame:
    """Join on every shared name (or ``on``), with NULL matching NULL.

    Keys appear once, taken from whichever side has the row. Shared names
    outside ``on`` keep both copies under the suffixes.
    """
    shared = shared_columns(left, right)
    keys = list(on) if on is not None else shared
    if not keys:
        raise ValueError("no shared column to join on")
    l, r = left.alias("l"), right.alias("r")
    match = _all([F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys])
    joined = l.join(r, match, how)
    if how in ("left_semi", "left_anti"):
        return joined
    twice = set(shared) - set(keys)
    side = {"right": "r"}.get(how, "l")

    def key(k):
        if how == "full":
            return F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k)
        return F.col(f"{side}.`{k}`").alias(k)

    def rest(table, mark, suffix):
        return [F.col(f"{mark}.`{c}`").alias(c + suffix if c in twice else c)
                for c in table.columns if c not in set(keys)]

    return joined.select(*[key(k) for k in keys], *rest(left, "l", suffixes[0]),
                         *rest(right, "r", suffixes[1]))


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    return natural_join(left, right, "left_anti", on)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    return natural_join(left, right, "left_semi", on)


def attach(rows: DataFrame, summary: DataFrame, keys: Sequence[str], how: str = "left",
           many: bool = False) -> DataFrame:
    """Join a per-key summary back to its rows.

    A counted-small summary is broadcast, so the rows stay where they are. A
    bigger one, or one known to have ``many`` keys, goes through a shuffle join,
    where hot keys are split.
    """
    return natural_join(rows, small_side(summary, many), how, keys)


def patch_from(rows: DataFrame, patches: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Replace ``value`` where the patches table has the key; other rows keep theirs."""
    marked = patches.select(*keys, F.col(value).alias("patched"), F.lit(True).alias("is_patch"))
    return (attach(rows, marked, keys)
            .withColumn(value, F.when(F.col("is_patch"), F.col("patched")).otherwise(F.col(value)))
            .select(*rows.columns))


def interval_join(readings: DataFrame, windows: DataFrame, keys: Sequence[str], time: str,
                  start: str = "start", stop: str = "stop", many: bool = False) -> DataFrame:
    """Readings inside the window of their key, both ends included.

    Readings without a window give no rows. ``windows`` must not share other
    names with ``readings``.
    """
    w = small_side(windows, many).alias("w")
    r = readings.alias("r")
    match = _all([F.col(f"r.`{k}`") == F.col(f"w.`{k}`") for k in keys]
                 + [F.col(f"r.`{time}`") >= F.col(f"w.`{start}`"),
                    F.col(f"r.`{time}`") <= F.col(f"w.`{stop}`")])
    extra = [F.col(f"w.`{c}`") for c in windows.columns if c not in keys]
    return r.join(w, match, "inner").select("r.*", *extra)


LEVEL_STEP = 3


def grid_pieces(start: Column, stop: Column) -> Column:
    """The one or two stretches that a window of slots (longs, both included) touches: an array of (level, place).

    A stretch of a level covers 2 ** level slots. The level is the first multiple of
    ``LEVEL_STEP`` whose stretches are as long as the window, so windows of any
    length have two pieces at most, and few levels are in use.
    """
    level = (F.ceil(F.log2(stop - start + 1) / LEVEL_STEP) * LEVEL_STEP).cast("int")
    places = F.array_distinct(F.array(F.call_function("shiftright", start, level), F.call_function("shiftright", stop, level)))
    return F.transform(places, lambda p: F.struct(level.alias("level"), p.alias("place")))


def exclude_windows(readings: DataFrame, windows: DataFrame, key: str, time: str,
                    start: str = "start", stop: str = "stop", slot_seconds: int = 60) -> DataFrame:
    """Drop readings inside a bad window; a window with a NULL key hits every key.

    A NULL start or stop is no bound; of such windows the last stop and the first
    start of a key say all, one row a key. Other windows are put into stretches of
    time about as long as they are, two at most. For each length of stretches in use
    an anti join has an equality on the stretch, so a reading meets only windows
    that are near, and nothing is asked of the readings before.
    """
    w = windows.select(F.col(key).alias("w_key"), F.col(start).alias("w_start"), F.col(stop).alias("w_stop"))
    w = w.filter(F.coalesce(F.col("w_start") <= F.col("w_stop"), F.lit(True)))
    opened = (w.filter(F.col("w_start").isNull() | F.col("w_stop").isNull()).groupBy("w_key").agg(
        F.max(F.when(F.col("w_start").isNull(), F.col("w_stop"))).alias("upto"),
        F.min(F.when(F.col("w_stop").isNull(), F.col("w_start"))).alias("since"),
        F.max(F.col("w_start").isNull() & F.col("w_stop").isNull()).alias("always")))
    at = {c: F.floor(seconds(c) / slot_seconds).cast("long") for c in ("w_start", "w_stop")}
    closed = w.filter(F.col("w_start").isNotNull() & F.col("w_stop").isNotNull()).withColumn("p", F.explode(grid_pieces(at["w_start"], at["w_stop"])))
    closed = closed.select("w_key", "w_start", "w_stop", "p.level", "p.place")
    of_every_key = F.col("w_key").isNull().alias("of_every_key")
    sizes = (closed.select("level", of_every_key).union(opened.select(F.lit(-1), of_every_key))
             .groupBy("level", "of_every_key").count().collect())  # two rows a level at most
    fits = sum(r["count"] for r in sizes) <= BROADCAST_ROWS
    if not fits:
        closed, opened = settle(closed), settle(opened)
    out = readings.withColumn("_slot", F.floor(seconds(time) / slot_seconds).cast("long"))
    t = F.col(time)
    for r in sizes:
        part = opened if r["level"] < 0 else closed.filter(F.col("level") == r["level"])
        part = part.filter(F.col("w_key").isNull() == r["of_every_key"])
        if r["level"] < 0:
            hit = t.isNotNull() & (F.coalesce(t <= F.col("upto"), F.lit(False)) | F.coalesce(t >= F.col("since"), F.lit(False)) | F.col("always"))
        else:
            hit = (F.shiftright("_slot", r["level"]) == F.col("place")) & t.between(F.col("w_start"), F.col("w_stop"))
        if not r["of_every_key"]:
            hit = (F.col(key) == F.col("w_key")) & hit
        # The open windows of all keys together are one row.
        small = fits or (r["level"] < 0 and r["of_every_key"])
        out = out.join(F.broadcast(part) if small else part, hit, "left_anti")
    return out.drop("_slot")


def lookup_at(series: DataFrame, instants: DataFrame, keys: Sequence[str], time: str,
              many: bool = False) -> DataFrame:
    """The reading taken at exactly the given instant of each key."""
    on = [*keys, time]
    return natural_join(series, small_side(instants, many), "inner", on)


def align(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Two series on shared time and names, keeping what either one has."""
    return natural_join(left, right, "full", on)
