"""Secrets in texts, through an incremental ledger of content-addressed blobs.

Every version of a path is named by the SHA-256 of its text. The ledger holds
one row for each scanned (blob, rule version) with its findings. A call scans
only pairs that the ledger lacks, once for each blob however many paths hold it,
appends them, and joins the findings of all blobs back to all paths. Findings of
a failed call are simply scanned again: the ledger is read distinct by pair.

A null text is empty. Every input row is a version and gives one row; a null id
stays null. Only the two named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path
from .spans import joined, matches, of_kind

ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
SHORTEST_VALUE = 6
_SPAN = "array<struct<s:int,rank:int,e:int,kind:string>>"
_LEDGER = f"blob string, rules string, found {_SPAN}"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    shortest: int = 0  # code points of the group; shorter matches are dropped


RULES = (Rule("assign", ASSIGN, 1, SHORTEST_VALUE), Rule("access", ACCESS), Rule("hex", HEX))
VERSION = "1"


def secrets(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All findings of a text, ordered by place and rule."""
    def spans(rank: int, rule: Rule) -> Column:
        kept = F.filter(matches(text, rule.pattern, rule.group), lambda x: F.length(x["m"]) >= rule.shortest)
        return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"),
                                                    F.lit(rule.kind).alias("kind"))).cast(_SPAN)
    return F.sort_array(F.concat(*[spans(rank, rule) for rank, rule in enumerate(rules)]))


class BlobLedger:
    """Findings by blob and rule version, as Parquet files in a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION):
        self.spark, self.rules, self.version = spark, rules, version
        self.path = path or fresh_path(spark, "ledger")

    def rows(self) -> DataFrame:
        """What this rule version has found so far; a blob scanned twice shows once."""
        self.spark.createDataFrame([], _LEDGER).coalesce(1).write.mode("append").parquet(self.path)
        known = self.spark.read.schema(_LEDGER).parquet(self.path).where(F.col("rules") == self.version)
        return known.groupBy("blob").agg(F.first("found").alias("found"))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per input row: id, blob and ``found``, an array of (s, rank, e, kind)."""
        d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        versions = d.select("id", F.sha2("text", 256).alias("blob"))
        unseen = versions.select("blob").distinct().join(self.rows().select("blob"), "blob", "left_anti")
        blobs = d.select(F.sha2("text", 256).alias("blob"), "text").join(unseen, "blob", "left_semi")
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
        (blobs.select("blob", F.lit(self.version).alias("rules"), secrets(F.col("text"), self.rules).alias("found"))
         .write.mode("append").parquet(self.path))
        hits = self.rows().where(F.size("found") > 0)
        return (versions.join(hits, "blob", "left")
                .select(F.col("id").alias(id_col), "blob", F.coalesce("found", F.array().cast(_SPAN)).alias("found")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, hash of the spans and the spans as text."""
    counts = [F.size(of_kind(F.col("found"), r.kind)).cast("long").alias(f"n_{r.kind}") for r in RULES]
    return found.select(id_col, *counts, F.sha2(joined(F.col("found")), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
