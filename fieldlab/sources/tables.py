"""Scans and sinks."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import parse_time
from ..operators.joins import interval_join, natural_join
from ..operators.verbs import rename_matching, snake_case
from ..session import configure, shared_dir, small_side

PARSER_COLUMNS = 20480  # Spark's CSV parser fails on a line of more cells


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Header CSV with a fixed schema; ``NA`` and empty cells are NULL.

    A byte-order mark is dropped by the reader. Names come out in snake case.
    """
    df = (spark.read.schema(schema).option("header", True).option("nullValue", "NA")
          .option("enforceSchema", True).csv(path))
    return snake_case(df)


def read_tree(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None,
              fmt: str = "csv", file_column: str = "file_id", **options) -> DataFrame:
    """All files under a folder in one scan, with the file's base name and path as columns."""
    reader = spark.read.format(fmt).option("recursiveFileLookup", True).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path).select("*", F.col("_metadata.file_name").alias(file_column),
                                    F.col("_metadata.file_path").alias("file_path"))


def read_log_tree(spark: SparkSession, path: str | list[str], columns: Sequence[str],
                  date: str, time: str | None = None, numbers: Sequence[str] = (),
                  file_column: str = "file_id") -> DataFrame:
    """Logger files with preamble and header lines of any number.

    Every line is read as text under the given names; lines whose time does not
    parse (preamble, header, blank) are dropped.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = read_tree(spark, path, schema, file_column=file_column, header=False, nullValue="NA")
    stamp = F.col(date) if time is None else F.concat_ws(" ", date, time)
    out = raw.withColumn("datetime", parse_time(stamp)).filter(F.col("datetime").isNotNull())
    return out.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in numbers})


def _cut(lines: DataFrame, separator: str, most_columns: int) -> DataFrame:
    """Adds ``cells``, those of the CSV line in ``value``, and ``plain``: cut at each separator, NULLs not yet made.

    The CSV parser is slow on lines with fewer cells than its schema. So it gets only the lines that need it: with
    quotes or NUL, with more cells than it takes, and all if the separator is not one character.
    """
    value = F.col("value")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(most_columns)])
    parsed = F.from_csv(value, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                        {"nullValue": "NA", "sep": separator, "mode": "PERMISSIVE"})
    # inside a lambda, a line is parsed once for all its cells
    parsed = F.transform(F.array(parsed), lambda row: F.array(*[row.getField(f.name) for f in schema]))[0]
    if len(separator) != 1 or separator in '"\\\0':
        return lines.select("*", parsed.alias("cells"), F.lit(False).alias("plain"))
    plain = ~(value.contains('"') | value.contains("\0")) & (F.length(value) < PARSER_COLUMNS)
    split = F.slice(F.split(value, re.escape(separator), most_columns + 1), 1, most_columns)
    return (lines.withColumn("plain", plain)
            .withColumn("cells", F.when(F.col("plain"), split).otherwise(parsed)))


def read_header_maps(spark: SparkSession, path: str | list[str], names: Mapping[str, str], separator: str = ",",
                     most_columns: int = 64, file_column: str = "file_id") -> DataFrame:
    """Logger files of a tree, each with a header wording, column order and preamble of its own.

    ``names`` maps a new name to a text that the column's header contains, in any
    case. A file's header is its first line with a cell for every name; it is
    looked for by the tasks that read the starts of files, and its positions, one
    row a file, are the map by which the cells of all lines of that file are
    picked. The header and what stands above it are dropped by place, whatever it
    looks like. Cells come as text, ``NA`` and empty as NULL; missing cells are
    NULL. A file without such a header gives no rows. Cells may be quoted but hold
    no line breaks; only the first ``most_columns`` cells of a line are seen.
    """
    lines = (spark.read.option("recursiveFileLookup", True).text(path)
             .select("value", F.col("_metadata.file_name").alias(file_column), F.col("_metadata.file_path").alias("file_path"),
                     (F.col("_metadata.file_block_start") == 0).alias("at_start"), F.monotonically_increasing_id().alias("line")))

    def place(text: str):
        cell = lambda c: F.when(F.col("plain") & c.isin("", "NA"), F.lit(None)).otherwise(c)
        holds = F.transform("cells", lambda c: F.coalesce(F.contains(F.lower(cell(c)), F.lit(text.lower())), F.lit(False)))
        return F.array_position(holds, True)
    # The whole line of a header holds the letters and digits of every name: cheaper to see, and most lines go.
    parts = [max(re.findall("[a-z0-9]+", text.lower()), key=len, default="") for text in names.values()]
    likely = reduce(lambda a, b: a & b, [F.contains(F.lower("value"), F.lit(p)) for p in parts], F.col("at_start"))
    found = _cut(lines.filter(likely), separator, most_columns).select(
        "file_path", "line", *[place(text).alias(f"at_{n}") for n, text in names.items()])
    whole = reduce(lambda a, b: a & b, [F.col(f"at_{n}") > 0 for n in names], F.lit(True))
    # A condition inside the aggregate: a filter would be pushed down and cut each line once for every name.
    headers = (found.groupBy("file_path").agg(F.min(F.when(whole, F.struct("line", *[f"at_{n}" for n in names]))).alias("header"))
               .filter(F.col("header").isNotNull())
               .select("file_path", F.col("header.line").alias("header_line"), *[F.col(f"header.at_{n}").alias(f"at_{n}") for n in names]))
    rows = natural_join(lines, small_side(headers), "inner", ["file_path"])
    # Lines are numbered along each split, so those of a file's start compare with its header.
    rows = rows.filter(~F.col("at_start") | (F.col("line") > F.col("header_line"))).filter(F.length(F.trim("value")) > 0)
    cell = {n: F.get("cells", (F.col(f"at_{n}") - 1).cast("int")) for n in names}
    return _cut(rows, separator, most_columns).select(
        *[F.when(~F.col("plain") | ~c.isin("", "NA"), c).alias(n) for n, c in cell.items()], file_column, "file_path")


def read_fuzzy_header(spark: SparkSession, path: str, names: Mapping[str, str], skip: int = 1) -> DataFrame:
    """One logger file whose header wording varies, below ``skip`` preamble lines.

    Only the header line is looked at on the driver; columns are found by the
    text they contain.
    """
    import csv
    header = next(csv.reader([spark.read.text(path).limit(skip + 1).collect()[skip][0]]))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return rename_matching(spark.read.schema(schema).option("nullValue", "NA").csv(path), names)


def logger_series(logs: DataFrame, values: Mapping[str, str], pattern: str = r"(\d+)",
                  file_column: str = "file_id") -> DataFrame:
    """Tidy (date, logger_id, values) table; the logger comes from the file name."""
    return logs.select(F.col("datetime").alias("date"),
                       F.regexp_extract(file_column, pattern, 1).alias("logger_id"),
                       *[F.col(c).alias(n) for c, n in values.items()])


def select_files(readings: DataFrame, manifest: DataFrame, key: str = "file_id", time: str = "datetime",
                 value: str | None = None, many: bool = False) -> DataFrame:
    """Keep what a manifest says of each file, in one join.

    Manifest columns: the key, ``keep_from``, ``from_incl``, ``keep_to``,
    ``to_incl`` and ``max_value``; NULL means no bound. Files it does not list
    are dropped; a file listed with no bounds is kept as it is.
    """
    t = F.col(time)
    lower = (F.col("keep_from").isNull() | (t > F.col("keep_from"))
             | (F.coalesce("from_incl", F.lit(True)) & (t == F.col("keep_from"))))
    upper = (F.col("keep_to").isNull() | (t < F.col("keep_to"))
             | (F.coalesce("to_incl", F.lit(True)) & (t == F.col("keep_to"))))
    keep = lower & upper
    if value:
        keep = keep & (F.col("max_value").isNull() | (F.col(value) <= F.col("max_value")))
    return (natural_join(readings, small_side(manifest, many), "inner", [key]).filter(keep)
            .select(*readings.columns))


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows written in the code.

    Passed as Arrow they become part of the plan with a known size, so joins
    with them are planned as broadcasts.
    """
    fields = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, r)) for r in rows]), schema=fields)


def write_stage(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage as Parquet and go on from the written table."""
    writer = df.write.mode("overwrite")
    if partition_by:
        # One writer per value and slice of rows; small files are merged by size.
        df = df.hint("rebalance", *partition_by)
        writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a stage below the shared folder."""
    base = shared_dir(spark)
    if base is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(base, "stages", f"{name}-{uuid.uuid4().hex}")


__all__ = ["read_parquet", "read_csv", "read_tree", "read_log_tree", "read_fuzzy_header", "read_header_maps",
           "logger_series", "select_files", "literal_table", "write_stage", "stage_path",
           "interval_join"]
