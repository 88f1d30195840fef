"""Registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import personal_data as pii
from . import secret_scan, sql
from .common import fresh_path, table
from .conversation_trie import conversation_trie, ordered_turns, shared_openings
from .decontaminate import find_benchmark
from .hard_negatives import hard_negatives
from .line_dedup import dedup_lines
from .near_dedup import near_classes
from .packing import pack_documents
from .phrase_dedup import dedup_bytes
from .quality import quality_rules
from .sharding import shard_documents
from .substring_dedup import dedup_sentences
from .warc import read_archives, write_archives


def op1_near_dedup(spark, folder):
    return near_classes(table(spark, folder, "documents"))


def op2_personal_data(spark, folder):
    return pii.digest(pii.personal_data(table(spark, folder, "documents")))


def op3_suffix_dedup(spark, folder):
    return dedup_bytes(table(spark, folder, "documents"))


def op4_substring_dedup(spark, folder):
    found = dedup_sentences(table(spark, folder, "documents"))
    return found.select("doc_id", "n_sentences", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_secret_scan(spark, folder):
    docs = table(spark, folder, "documents")
    return secret_scan.digest(secret_scan.BlobLedger(spark).scan(docs))


def op6_warc(spark, folder):
    pages = table(spark, folder, "pages")
    path = fresh_path(spark, "archives")
    write_archives(pages, path)
    return read_archives(spark, path).select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))


def op7_best_fit_packing(spark, folder):
    return pack_documents(table(spark, folder, "documents"))


def op8_line_dedup(spark, folder):
    found = dedup_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality_rules(spark, folder):
    return quality_rules(table(spark, folder, "documents")).drop("clean_text")


def op10_decontamination(spark, folder):
    return find_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_sharding(spark, folder):
    return shard_documents(table(spark, folder, "documents"))


def op12_conversation_trie(spark, folder):
    return conversation_trie(*shared_openings(ordered_turns(table(spark, folder, "conversations")))).drop("node", "parent")


def op13_hard_negatives(spark, folder):
    vectors = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_personal_data, op3_suffix_dedup, op4_substring_dedup, op5_secret_scan, op6_warc,
    op7_best_fit_packing, op8_line_dedup, op9_quality_rules, op10_decontamination,
    op11_sharding, op12_conversation_trie, op13_hard_negatives)}
SQL = sql.STATEMENTS
