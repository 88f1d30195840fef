"""Exact quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle, small_side
from .joins import attach, natural_join
from .ordered import ROWS_PER_TASK

# A bracket is cut at so many quantiles of a mergeable sketch in a round.
CUTS = 64
SKETCH_ACCURACY = 1000


def _wanted(n: Column, probs: dict[str, float]) -> Column:
    """Positions, from 0, of the two values between which each quantile lies."""
    return F.array(*[F.struct(F.lit(f"{name} {end}").alias("name"), edge((n - 1) * F.lit(float(p))).cast("long").alias("pos"))
                     for name, p in probs.items() for end, edge in (("lo", F.floor), ("hi", F.ceil))])


def narrowed(x: DataFrame, keys: list[str], brackets: DataFrame, rows_per_task: int) -> DataFrame:
    """Shrink brackets (keys, name, n, pos, low, high, below, inside) until each holds few rows or one value.

    In a round a sketch of the rows inside proposes cuts, the cells between them
    are counted, and the cell with the wanted position is the next bracket. The
    counts decide, so what the sketch is off costs a round at most; the least value
    is always a cell of its own, so every round makes progress.
    """
    while True:
        brackets = settle(brackets)
        wide = (F.col("inside") > rows_per_task) & ~F.coalesce(F.col("low") == F.col("high"), F.lit(False))
        if brackets.filter(wide).isEmpty():
            return brackets
        opened = small_side(brackets.filter(wide))
        within = (natural_join(x, opened, "inner", keys)
                  .filter((F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))))
        cuts = within.groupBy(*keys, "name").agg(F.array_append(
            F.percentile_approx("v", [i / CUTS for i in range(CUTS + 1)], SKETCH_ACCURACY), F.min("v")).alias("cuts"))
        celled = natural_join(within.select(*keys, "name", "v"), small_side(cuts), "inner", [*keys, "name"])
        cell = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        counts = celled.groupBy(*keys, "name", cell.alias("cell")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("cell_low"),
                                                                       F.max("v").alias("cell_high"))
        upto = Window.partitionBy(*keys, "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = natural_join(counts, opened, "inner", [*keys, "name"])
        counts = counts.withColumn("before", F.col("below") + F.sum("c").over(upto) - F.col("c"))
        hit = (F.col("pos") >= F.col("before")) & (F.col("pos") < F.col("before") + F.col("c"))
        nearer = counts.filter(hit).select(*keys, "name", "n", "pos", F.col("cell_low").alias("low"), F.col("cell_high").alias("high"),
                                           F.col("before").alias("below"), F.col("c").alias("inside"))
        brackets = brackets.filter(~wide).unionByName(nearer)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Interpolated quantiles (the usual type 7) per key, and the count ``n``.

    Equal values are merged, and the merged values of a key of up to
    ``rows_per_task`` rows are searched in one window. Around each position of a
    longer key a bracket is narrowed first, so a window never holds more. NaN is the
    largest value.
    """
    keys = list(keys)
    x = df.select(*keys, F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    sizes = settle(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    whole = (sizes.filter(F.col("n") <= rows_per_task)
             .withColumns({"name": F.lit(None).cast("string"), "wanted": _wanted(F.col("n"), probs), "below": F.lit(0).cast("long")}))
    long = sizes.filter(F.col("n") > rows_per_task)
    rows = x
    if long.isEmpty():
        merged = x.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("m")).withColumn("name", F.lit(None).cast("string"))
        targets = whole
    else:
        brackets = narrowed(x, keys, long.withColumn("w", F.explode(_wanted(F.col("n"), probs))).select(
            *keys, "w.name", "n", "w.pos", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
            F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), rows_per_task)
        single = F.array(F.struct("name", "pos")).alias("wanted")
        targets = whole.select(*keys, "name", "n", "wanted", "below").unionByName(brackets.select(*keys, "name", "n", single, "below"))
        bounds = whole.select(*keys, "name", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")).unionByName(
            brackets.select(*keys, "name", "low", "high"))
        rows = (natural_join(x, small_side(bounds), "inner", keys)
                .filter((F.col("low").isNull() | (F.col("v") >= F.col("low"))) & (F.col("high").isNull() | (F.col("v") <= F.col("high")))))
        merged = rows.groupBy(*keys, "name", "v").agg(F.count(F.lit(1)).alias("m"))
    group = [*keys, "name"]
    upto = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = merged.withColumn("upto", F.sum("m").over(upto))
    found = (natural_join(numbered, small_side(targets), "inner", group)
             .withColumns({"end": F.col("below") + F.col("upto"), "w": F.explode("wanted")}))
    begin = F.col("end") - F.col("m")

    def pick(name, end):
        here = (F.col("w.name") == f"{name} {end}") & (F.col("w.pos") >= begin) & (F.col("w.pos") < F.col("end"))
        return F.max(F.when(here, F.col("v")))

    def between(p):
        exact = (F.max("n") - 1) * F.lit(float(p))
        return exact - F.floor(exact)

    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[
        (pick(name, "lo") + (pick(name, "hi") - pick(name, "lo")) * between(p)).alias(name) for name, p in probs.items()])


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}).drop("n")


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles and the whiskers: extreme values within 1.5 box lengths."""
    box = small_side(exact_quantiles(df, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    ends = attach(df.select(*keys, value), box, keys).groupBy(*keys, "q1", "q2", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"))
    return ends
