"""WARC archives written by Spark and read back by boundary-chain verification.

Writing: one record per page. Of pages with equal payloads of at least
``least_bytes`` the smallest id is a response, the others are revisits without a
block that name it. Spark's text writer puts the records into archive files.

Reading: files are split at the record magic anywhere, also inside a payload.
Each task lists the candidates of its split and, from their Content-Length, the
offset of the record that should follow. Split lengths give places in the file.
From offset 0 pointer jumping marks what can be reached; other candidates are
text inside payloads, whose pieces are put together again.

A null payload is empty. A null id counts as the largest and is written as the
empty name. Rows with the same id and payload as a response are responses too.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, fresh_path, ordered_id, store

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
LEAST_BYTES = 0
NAME = "urn:page:"
WRITTEN_AT = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: str, url: str, payload: bytes, refers_to: str | None) -> str:
    """A record without the blank lines that end it."""
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{NAME}{page}>",
            f"WARC-Date: {WRITTEN_AT}", f"WARC-Target-URI: {' '.join(url.split())}",
            f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{NAME}{refers_to}>", f"WARC-Original-Length: {len(payload)}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return MAGIC + "\r\n".join(head) + END + payload.decode()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "first")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([record(i or "", u or "", (p or "").encode(), f) for i, u, p, f in rows], pa.string())], names=["value"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_bytes: int = LEAST_BYTES) -> None:
    p = pages.select(ordered_id(id_col).alias("d"), F.col(id_col).cast("string").alias("id"),
                     F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    size = F.octet_length("payload")
    key = F.unhex(F.sha2("payload", 256))
    named = p.where(size >= least_bytes).select("d", key.alias("key"))
    first = named.groupBy("key").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    later = store(named.join(first, "key").where("d > first").select("d", "key", "first").distinct(), "revisits")
    linked = p.withColumn("key", key).join(few(later), ["d", "key"], "left")
    name = F.when(F.col("first").isNotNull(), F.col("first").cast("string"))
    (linked.select("id", "url", "payload", name.alias("first")).mapInArrow(_records, "value string")
     .write.option("lineSep", END).text(path))


def _header(segment: bytes) -> tuple[int, dict[str, str]]:
    """Length of the header with its blank line (-1 if there is none), and the named fields."""
    end = segment.find(END.encode())
    if end < 0:
        return -1, {}
    fields = dict(line.split(": ", 1) for line in segment[:end].decode("utf-8", "replace").split("\r\n") if ": " in line)
    return end + len(END), fields


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece between magics: its split, place in the split, size, and the offset from it to its successor."""
    at: dict[tuple, int] = {}
    for batch in batches:
        rows = []
        for file, begin, value in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "value"))):
            place = at.get((file, begin), 0)
            size = len(value) + len(MAGIC)
            body, fields = _header(value)
            length = fields.get("Content-Length", "")
            step = len(MAGIC) + body + int(length) + len(END) if body >= 0 and length.isdigit() and "WARC-Type" in fields else None
            rows.append((file, begin, place, size, step))
            at[(file, begin)] = place + size
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.string()] + [pa.int64()] * 4)],
            names=["file", "begin", "place", "size", "step"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: dict[tuple, int] = {}
    for batch in batches:
        rows = []
        for file, begin, value in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "value"))):
            place = at.get((file, begin), 0)
            rows.append((file, begin, place, value))
            at[(file, begin)] = place + len(value) + len(MAGIC)
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.binary()])],
            names=["file", "begin", "place", "value"])


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Pieces between magics, in the order of each split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"),
        F.col("value").cast("binary").alias("value"))


def reachable(steps: DataFrame) -> DataFrame:
    """Pointer jumping over (file, at, next) from offset 0 of each file: rows (file, at)."""
    jump = steps.select("file", "at", "next")
    seen = store(jump.where("at = 0").select("file", "at"), "reached")
    count = seen.count()
    while True:
        further = seen.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        seen = store(seen.union(further.join(steps.select("file", "at"), ["file", "at"], "left_semi")).distinct(), "reached")
        now = seen.count()
        if now == count:
            return seen
        count = now
        ahead = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = store(jump.join(ahead, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jumps")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            whole = MAGIC.encode().join(x["value"] for x in sorted(parts, key=lambda x: x["at"]))
            body, fields = _header(whole)
            payload = whole[body:body + int(fields["Content-Length"])]
            revisit = fields["WARC-Type"] == "revisit"
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            intact = revisit or digest == base32_sha1(payload)
            name = lambda key: fields[key].strip("<>").removeprefix(NAME) if key in fields else None
            rows.append((name("WARC-Record-ID") or None, fields.get("WARC-Target-URI"), fields["WARC-Type"],
                         int(fields["WARC-Original-Length"]) if revisit else len(payload), digest,
                         name("WARC-Refers-To"), intact, None if revisit else payload.decode()))
        columns = list(zip(*rows)) if rows else [[]] * 8
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)],
            names=["page", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "intact", "payload"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page, url, record_type, payload_bytes, payload_digest, refers_to, intact, payload."""
    found = store(_scan(spark, path).mapInArrow(_candidates, "file string, begin long, place long, size long, step long"), "candidates")
    splits = found.groupBy("file", "begin").agg(F.sum("size").alias("size"))
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    # The piece before the first magic of a file is empty and has no magic of its own.
    base = store(splits.select("file", "begin", (F.coalesce(F.sum("size").over(before), F.lit(0)) - len(MAGIC)).alias("base")), "splits")
    at = F.col("base") + F.col("place")
    steps = store(found.join(base, ["file", "begin"]).where("step is not null")
                  .select("file", at.alias("at"), (at + F.col("step")).alias("next")), "steps")
    true = reachable(steps)
    # Each piece belongs to the last reached record at or before it; most records are one piece.
    places = found.join(base, ["file", "begin"]).select("file", "begin", "place", at.alias("at")).where("at >= 0")
    marked = places.join(true.withColumn("start", F.col("at")), ["file", "at"], "left")
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = store(marked.select("file", "begin", "place", "at", F.max("start").over(upto).alias("start")), "owned")
    lone = owned.groupBy("file", "start").agg(F.count("*").alias("n"))
    owned = owned.join(lone, ["file", "start"]).select("file", "begin", "place", "at", "start", (F.col("n") == 1).alias("lone"))
    pieces = _scan(spark, path).mapInArrow(_pieces, "file string, begin long, place long, value binary")
    pieces = pieces.join(few(store(owned, "owners")), ["file", "begin", "place"])
    part = F.struct("at", "value")
    whole = (pieces.where("lone").select(F.array(part).alias("parts"))
             .union(pieces.where("not lone").groupBy("file", "start").agg(F.collect_list(part).alias("parts")).select("parts")))
    return whole.mapInArrow(_parsed, "page string, url string, record_type string, payload_bytes long, payload_digest string, "
                            "refers_to string, intact boolean, payload string")
