"""Tail of the studentised range as a relation: rows times quadrature nodes, summed in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .normal import normal_upper


def range_tails(df: DataFrame, q: str, means: str, dof: str, name: str = "p") -> DataFrame:
    """df with P(studentised range of ``means`` means and ``dof`` degrees of freedom > q).

    The trapezoid rule over the logarithm of the standard deviation and over the
    largest of the normal values converges beyond any power of its step for these
    integrands, so each row meets some ten thousand nodes, which are sequences
    made in the task that holds the row. NULL if q is NULL or NaN or there are no
    degrees of freedom; 1 for q of 0 or less otherwise.
    """
    columns = list(df.columns)
    tasks = df.sparkSession.sparkContext.defaultParallelism
    rows = df.withColumn("_row", F.monotonically_increasing_id()).repartition(tasks, "_row")
    x, k, v = F.col(q).cast("double"), F.col(means).cast("double"), F.col(dof).cast("double")
    v = F.when(v > 0, v)
    good = (x > 0) & (x < float("inf")) & v.isNotNull() & (k > 1)
    spread = 1.0 / F.sqrt(2.0 * v)
    # The range of many means is narrow, on both scales.
    rows = rows.withColumns({"_step": F.least(spread / 2.0, F.when(k <= 64, 0.12).otherwise(0.03)),
                             "_low": -0.5 * F.log1p(x * x / (2.0 * v)) - 10.0 * spread - 40.0 / v,
                             "_gap": F.when(k <= 64, 0.25).otherwise(0.125)})
    steps = F.ceil((10.0 * spread - F.col("_low")) / F.col("_step")).cast("int")
    rows = rows.withColumn("_i", F.explode_outer(F.when(good, F.sequence(F.lit(0), steps))))
    y = F.col("_low") + F.col("_i") * F.col("_step")
    rows = rows.withColumns({"_w": x * F.exp(y), "_d": F.exp(v * (y - 0.5 * F.expm1(2.0 * y)))})
    nodes = (48.0 / F.col("_gap")).cast("int")
    rows = rows.withColumn("_u", F.explode_outer(F.when(F.col("_i").isNotNull(), F.sequence(F.lit(0), nodes))))
    rows = rows.withColumn("_u", -9.0 + F.col("_u") * F.col("_gap"))
    below = normal_upper(-F.col("_u"))
    gone = F.least(normal_upper(F.col("_w") - F.col("_u")) / below, F.lit(1.0 - 1e-16))
    part = (k * F.col("_gap") * (2.0 * math.pi) ** -0.5 * F.exp(-0.5 * F.col("_u") * F.col("_u"))
            * F.pow(below, k - 1.0) * -F.expm1((k - 1.0) * F.log1p(-gone)))
    sums = rows.groupBy("_row", *columns).agg(F.sum(F.col("_d") * part).alias("_top"), F.sum("_d").alias("_all"),
                                              F.max(nodes + 1).alias("_nodes"))
    tail = F.try_divide(F.col("_top") * F.col("_nodes"), F.col("_all"))
    return sums.select(*columns, F.when(v.isNotNull() & (x <= 0), 1.0).when(tail > 1.0, 1.0).otherwise(tail).alias(name))
