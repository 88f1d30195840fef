"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, shared_dir

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 9223372036854775807
#: A table is broadcast only if it was written, counted, and has at most so many
#: rows of a few fixed-width fields (16 MB at 32 bytes a row).
FEW_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, and a lost executor takes no rows with it."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """Hint a broadcast for a stored table of a few fixed-width columns if its count is under the bound.

    Beyond the bound the same join shuffles, and adaptive execution splits its hot keys.
    """
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``, which may use it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ordered_id(name: str) -> Column:
    """Identifier for comparisons; a null id counts as the largest of all."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def space_words(c: Column) -> Column:
    """Runs of characters other than the six ASCII spaces."""
    return let(trimmed(c), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))
