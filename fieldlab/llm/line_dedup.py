"""Exact line removal across documents with levelled sorted runs of line hashes.

``LineRuns`` keeps (line hash, first document) in runs that are bucketed and
sorted by the hash. A new batch is joined against the runs (a merge join without
moving the runs), its unseen hashes become a new run, and when a level holds
``fanout`` runs they are compacted into one run of the next level, bucket by bucket
in merge joins that move no rows. Batches are cut at quantiles of the ids and come
in ascending order, so the first holder of a line is its smallest id.

Null or empty texts are one empty line and lose nothing; a long text is split as
any other. Rows that share an id are one document. A null id counts as the largest
id and comes in the last batch, whatever the others are; rows without any id are one
batch. Only the two named columns are read; others do no harm whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, ascii_lower, fresh_path, let, ordered_id, store, trimmed

SHORTEST_KEY = 10
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    return ascii_lower(trimmed(line))


class LineRuns:
    """Levels of sorted runs in the shared folder; ``absorb`` takes one batch at a time."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _write(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by the hash of the key -> a bucketed, sorted run."""
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, "key").sortBy("key")
             .option("path", fresh_path(self.spark, "line-run")).saveAsTable(name))
        return self.spark.table(name)

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs share no key; as they are bucketed alike, the full join reads bucket beside bucket."""
        return (a.join(b.withColumnRenamed("first", "other"), "key", "full")
                .select("key", F.coalesce("first", "other").alias("first")))

    def _add(self, run: DataFrame, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(lambda a, b: self._write(self.merged(a, b)), self.levels[level])
            self.levels[level] = []
            self._add(merged, level + 1)

    def absorb(self, lines: DataFrame) -> DataFrame:
        """lines (key, doc, ...) of one batch -> those held by an earlier document; the runs then know the batch."""
        held = lines.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        fresh = held
        for run in self.runs():
            fresh = fresh.join(run.select("key"), "key", "left_anti")
        fresh = self._write(fresh.repartition(self.buckets, "key"))
        old = held.join(fresh.select("key"), "key", "left_anti").select("key", F.lit(None).cast("long").alias("first"))
        twice = fresh.where("first < last").select("key", "first")
        gone = old.union(twice)
        found = lines.join(gone, "key").where(F.col("first").isNull() | (F.col("doc") > F.col("first"))).drop("first", "key")
        self._add(fresh.select("key", "first"))
        return found


def id_ranges(lines: DataFrame, batches: int) -> list[Column]:
    """Conditions that cut the rows into batches of like size by quantiles of the known ids; the last one takes null ids too."""
    known = F.when(F.col("doc") != LAST_ID, F.col("doc"))
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(lines.agg(F.percentile_approx(known, shares)).first()[0] or [])) if shares else []
    after = [F.lit(True)] + [F.col("doc") > c for c in cuts]
    return [a & (F.col("doc") <= c) for a, c in zip(after, cuts)] + after[-1:]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
                fanout: int = FANOUT, shortest: int = SHORTEST_KEY, carry: str = "") -> DataFrame:
    """One row per input row: id (or the column ``carry``), n_lines, n_dropped and the kept text."""
    spark = docs.sparkSession
    d = docs.select(F.col(carry or id_col).alias("id"), ordered_id(id_col).alias("doc"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("row", F.xxhash64("text"))
    lines = (d.select("doc", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .select("doc", "row", "pos", line_key(F.col("line")).alias("line"))
             .where(F.length("line") >= shortest)
             .select("doc", "row", "pos", F.unhex(F.md5("line")).alias("key")))
    lines = store(lines, "lines")
    runs = LineRuns(spark, fanout)
    dropped = [runs.absorb(lines.where(part)) for part in id_ranges(lines, batches)]
    gone = reduce(DataFrame.union, dropped)
    gone = gone.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    out = d.join(gone, ["doc", "row"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    return out.select(F.col("id").alias(carry or id_col), F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
                      F.size("gone").cast("long").alias("n_dropped"),
                      F.when(F.size("gone") == 0, F.col("text")).otherwise(kept).alias("kept_text"))
