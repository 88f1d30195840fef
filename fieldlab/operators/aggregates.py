"""Grouped summaries with explicit NULL behaviour.

All of them combine on the map side, so a hot key costs one partial row per
task and not one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import as_column, recode
from .joins import attach


def strict(agg, c: Column | str) -> Column:
    """``agg(c)``, but NULL as soon as one input is NULL."""
    c = as_column(c)
    return F.when(F.count(c) == F.count(F.lit(1)), agg(c))


def aggregate(agg, c: Column | str, skip_null: bool) -> Column:
    return agg(as_column(c)) if skip_null else strict(agg, c)


def std_error(c: Column | str) -> Column:
    """Sample deviation over the root of the number of non-missing values."""
    c = as_column(c)
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def mean_se(df: DataFrame, keys: Sequence[str], value: str, names=("mean", "sd", "se"),
            skip_null: bool = True) -> DataFrame:
    mean, sd, se = names
    return df.groupBy(*keys).agg(
        aggregate(F.avg, value, skip_null).alias(mean),
        aggregate(F.stddev_samp, value, skip_null).alias(sd),
        std_error(value).alias(se))


def spread(df: DataFrame, keys: Sequence[str], values: Mapping[str, str], skip_null: bool = True) -> DataFrame:
    """Mean, SE, minimum, maximum and range; ``values`` maps column to suffix."""
    out = []
    for c, tag in values.items():
        low, high = aggregate(F.min, c, skip_null), aggregate(F.max, c, skip_null)
        out += [aggregate(F.avg, c, skip_null).alias(f"mean_{tag}"), std_error(c).alias(f"se_{tag}"),
                low.alias(f"min_{tag}"), high.alias(f"max_{tag}"), (high - low).alias(f"range_{tag}")]
    return df.groupBy(*keys).agg(*out)


def daily(df: DataFrame, keys: Sequence[str], time: str, values: Mapping[str, str]) -> DataFrame:
    """Calendar-day mean, maximum, minimum and range per key."""
    out = []
    for c, tag in values.items():
        out += [F.avg(c).alias(f"mean_{tag}"), strict(F.max, c).alias(f"max_{tag}"),
                strict(F.min, c).alias(f"min_{tag}"),
                (strict(F.max, c) - strict(F.min, c)).alias(f"range_{tag}")]
    return df.groupBy(*keys, F.to_date(time).alias("day")).agg(*out)


def sole_or_repeated(df: DataFrame, keys: Sequence[str], repeated: bool = False) -> DataFrame:
    """Keys seen once (unpaired), or more than once (duplicated), with the count."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") > 1) if repeated else n.filter(F.col("n") == 1)


def share_of_total(df: DataFrame, group: Sequence[str], item: str, amount: str,
                   name: str = "cover") -> DataFrame:
    """Percent of the group total held by each item.

    The total covers every item, also those a later step excludes. Only the
    already summed (group, item) rows pass through the window.
    """
    sums = df.groupBy(*group, item).agg(F.sum(amount).alias("amount"))
    total = F.sum("amount").over(Window.partitionBy(*group))
    return sums.select(*group, item, "amount",
                       (F.try_divide(F.col("amount"), total) * 100.0).alias(name))


def level_difference(df: DataFrame, keys: Sequence[str], level: str, value: str, low: str,
                     high: str, name: str = "difference") -> DataFrame:
    """Percent difference of two level means, relative to the second."""
    a = F.avg(F.when(F.col(level) == low, F.col(value)))
    b = F.avg(F.when(F.col(level) == high, F.col(value)))
    return df.groupBy(*keys).agg(a.alias("low"), b.alias("high")).withColumn(
        name, F.try_divide(100.0 * (F.col("low") - F.col("high")), F.col("high")))


def baseline(df: DataFrame, keys: Sequence[str], is_blank: Column, value: str,
             name: str = "blank_rate", skip_null: bool = True) -> DataFrame:
    """Mean of the blank rows of each block."""
    return df.filter(is_blank).groupBy(*keys).agg(aggregate(F.avg, value, skip_null).alias(name))


def with_group_value(df: DataFrame, keys: Sequence[str], many: bool = False, **aggs: Column) -> DataFrame:
    """Group aggregates written beside each row.

    A window would send a whole group to one task; summing first and joining
    back leaves a hot group spread out.
    """
    return attach(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys, many=many)


def combine_parts(df: DataFrame, keys: Sequence[str], member: str, aliases: Mapping[str, str], values: Sequence[str]) -> DataFrame:
    """Sums per unit after records that are parts of one member got its name; one missing part makes a sum NULL."""
    named = df.withColumn(member, recode(member, aliases))
    return named.groupBy(*keys, member).agg(*[strict(F.sum, v).alias(v) for v in values])
