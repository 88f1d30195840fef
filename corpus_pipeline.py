"""Documents to packed training sequences, in five stages that each apply one corpus operator.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes
each result as Parquet to the shared folder and hands the reread table on. All
but the last return the columns of documents.

Null ids: a null id is the largest id in comparisons. Repeated rows are judged
alike and stay together. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import few, ordered_id, store, table
from fieldlab.llm.decontaminate import find_benchmark
from fieldlab.llm.line_dedup import dedup_lines
from fieldlab.llm.near_dedup import near_classes
from fieldlab.llm.packing import pack_documents
from fieldlab.llm.quality import quality_rules

ORACLE_SQL = None  # sketches, alignment and packing have no SQL; tests hold the stages against brute force


def _apart(docs: DataFrame) -> DataFrame:
    """Text, id, and all other columns in one struct that an operator carries along."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "doc_id", "text")


def _with_text(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The columns of docs with a new text."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return found.select(*[(new[c] if c in new else F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c)
                          for c in docs.columns])


def _version() -> Column:
    return F.struct(ordered_id("doc_id").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines."""
    return _with_text(docs, quality_rules(_apart(docs), id_col="row").where("kept"), "clean_text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; documents stay, if need be empty."""
    return _with_text(docs, dedup_lines(_apart(docs), carry="row"), "kept_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays; documents are told apart by id and text."""
    other = near_classes(docs, version="_other").where(~F.col("kept")).select("_other").distinct()
    return docs.join(few(store(other, "near-duplicates")), _version() == F.col("_other"), "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark passages go."""
    version = _version()
    found = find_benchmark(docs.select(version.alias("version"), "text"), table(spark, sf_dir, "benchmark"), id_col="version")
    bad = store(found.where("contaminated").select(F.col("version").alias("_version")).distinct(), "contaminated")
    return docs.join(few(bad), version == F.col("_version"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in training sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates),
          ("decontamination", decontaminate), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
