"""Bytes repeated from earlier documents, by prefix-free parsing into phrases.

A rolling hash over ``WIDTH`` bytes is a trigger where it is the smallest of the
``REACH`` + 1 hashes of some ``LENGTH``-byte string, so every such string holds a
trigger, and equal strings hold equal triggers at equal places. Triggers cut the
texts into phrases; what a ``LENGTH``-byte string can be is a suffix of the
phrase before a trigger, the trigger, and a prefix of what the parse has after
it. Three passes over the corpus, which is written once in batches:

1. Which triggers occur in more than one document. Tasks send sorted hashes by
   bucket, the bucket answers with a bit for each.
2. For those triggers, the distinct surroundings with their smallest document.
   A bucket sorts them twice, by what precedes the trigger (the dictionary's
   suffixes) and by what follows (the parse), takes common prefix lengths, and
   combines the ranks of both orders: two strings at the same place are equal
   where both ranks are. The answer tells which of the strings around a trigger
   occur in a smaller document. Bytes are compared, never hashes.
3. Tasks mark the bytes of those strings and hash what is left.

The corpus is bucketed by batch, so its text is not shuffled for passes 2 and 3.
Exact copies of a smaller document are set aside first. A trigger however common
is sent once per batch and surroundings.

A null text is empty. Rows sharing an id are one document: they take nothing from
each other. A null id counts as the largest. Every input row gives one row. Only
the two named columns are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, fresh_path, ordered_id, store

LENGTH = 50
WIDTH = 24
REACH = LENGTH - WIDTH
AROUND = REACH + WIDTH + REACH
BATCH_BYTES = 2_000_000
_EMPTY = hashlib.sha256().hexdigest()


def _hashes(x: np.ndarray) -> np.ndarray:
    """Mixed hashes of all strings of WIDTH = 16 + 8 bytes."""
    h = x.astype(np.uint64) + np.uint64(1)
    base, eight = 0x9E3779B97F4A7C15, h
    for n in (1, 2, 4, 8):
        eight = h
        h = h[:-n] * np.uint64(base) + h[n:]
        base = base * base % 2 ** 64
    n = len(x) - WIDTH + 1
    h = h[:n] * np.uint64(0xD6E8FEB86659FD93) + eight[16:16 + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each stretch of ``width`` elements."""
    done = 1
    out = x
    while 2 * done <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    return out if done == width else pick(out[:len(x) - width + 1], out[width - done:])


def triggers(data: np.ndarray, slice_bytes: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the triggers; work is done in slices that overlap by what a place depends on."""
    places, hashes = [], []
    for low in range(0, len(data), slice_bytes):
        first = max(0, low - REACH)
        part = data[first:low + slice_bytes + LENGTH]
        if len(part) < LENGTH:
            continue
        h = _hashes(part)
        least = _sliding(h, REACH + 1, np.minimum)
        pad = np.zeros(REACH, np.uint64)
        most = _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
        at = np.flatnonzero(most == h)
        place = at + first
        mine = (place >= low) & (place < low + slice_bytes)
        places.append(place[mine])
        hashes.append(h[at[mine]])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


class Batch:
    """The triggers of one batch of documents, by bucket and hash."""

    def __init__(self, row: dict, buckets: int):
        self.docs = np.asarray(row["docs"], np.int64)
        self.ends = np.cumsum(np.asarray(row["sizes"], np.int64))
        self.starts = self.ends - np.asarray(row["sizes"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        place, h = triggers(self.data)
        owner = np.searchsorted(self.ends, place, "right")
        whole = place + WIDTH <= self.ends[owner] if len(place) else np.zeros(0, bool)
        self.place, self.owner, h = place[whole], owner[whole], h[whole]
        bucket = h % np.uint64(buckets)
        self.key = (bucket << np.uint64(32)) | ((h // np.uint64(buckets)) & np.uint64(0xFFFFFFFF))
        self.keys, self.nth = np.unique(self.key, return_inverse=True)
        self.buckets = (self.keys >> np.uint64(32)).astype(np.int64)

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        return _stretches(self.buckets)

    def in_several(self) -> np.ndarray:
        """For each distinct hash, whether documents of this batch share it."""
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.nth, self.docs[self.owner])
        np.maximum.at(high, self.nth, self.docs[self.owner])
        return low < high

    def keep(self, answers: list[dict] | None) -> None:
        """Leave the occurrences whose hash is shared."""
        shared = np.zeros(len(self.keys), bool)
        bits = {a["bucket"]: a["bits"] for a in answers or []}
        for bucket, part in self.by_bucket():
            if bucket in bits:
                shared[part] = np.unpackbits(np.frombuffer(bits[bucket], np.uint8))[:part.stop - part.start]
        mine = shared[self.nth]
        self.place, self.owner, self.key = self.place[mine], self.owner[mine], self.key[mine]
        self.before = np.minimum(REACH, self.place - self.starts[self.owner])
        self.after = np.minimum(REACH, self.ends[self.owner] - self.place - WIDTH)
        fits = self.before + self.after >= REACH
        for name in ("place", "owner", "key", "before", "after"):
            setattr(self, name, getattr(self, name)[fits])
        column = np.arange(AROUND)
        spot = self.place[:, None] - REACH + column
        around = self.data[np.clip(spot, 0, max(0, len(self.data) - 1))] if len(self.data) else np.zeros((0, AROUND), np.uint8)
        inside = (column >= REACH - self.before[:, None]) & (column < REACH + WIDTH + self.after[:, None])
        around = np.where(inside, around, 0).astype(np.uint8)
        row = np.concatenate([(self.key >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4), around,
                              self.before[:, None].astype(np.uint8), self.after[:, None].astype(np.uint8)], axis=1)
        flat = np.ascontiguousarray(row).view(np.dtype((np.void, row.shape[1]))).ravel()
        self.forms, first, self.form = np.unique(flat, return_index=True, return_inverse=True)
        self.around, self.form_before, self.form_after = around[first], self.before[first], self.after[first]
        self.form_bucket = (self.key[first] >> np.uint64(32)).astype(np.int64)
        self.form_doc = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.form_doc, self.form, self.docs[self.owner])


def _stretches(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield int(sorted_values[a]), slice(int(a), int(b))


def _batches(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents joined into rows of about BATCH_BYTES."""
    task, n = TaskContext.get().partitionId(), 0
    docs, sizes, texts, size = [], [], [], 0

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([task * 2 ** 32 + n]), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([b"".join(texts)], pa.binary())], names=["batch", "docs", "sizes", "data"])
    for record in records:
        for doc, text in zip(record.column("d"), record.column("data")):
            text = text.as_py()
            if docs and size + len(text) > BATCH_BYTES:
                yield row()
                docs, sizes, texts, size, n = [], [], [], 0, n + 1
            docs.append(doc.as_py())
            sizes.append(len(text))
            texts.append(text)
            size += len(text)
    if docs:
        yield row()


def _rows(record: pa.RecordBatch) -> Iterator[dict]:
    for i in range(record.num_rows):
        yield {name: record.column(name)[i].as_py() for name in record.schema.names}


def _asks(buckets: int):
    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for row in _rows(record):
                b = Batch(row, buckets)
                several = b.in_several()
                out = [(row["batch"], bucket, b.keys[part].astype("<u4").tobytes(), np.packbits(several[part]).tobytes())
                       for bucket, part in b.by_bucket()]
                yield pa.RecordBatch.from_pydict(dict(zip(("batch", "bucket", "hashes", "several"), zip(*out))) if out else
                                                 {"batch": [], "bucket": [], "hashes": [], "several": []}, schema=_ASK)
    return run


_ASK = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("several", pa.binary())])


def _shared(group: pa.Table) -> pa.Table:
    """One bucket of pass 1: a bit for each hash of each batch, set if documents share it."""
    parts = [np.frombuffer(x.as_py(), "<u4") for x in group.column("hashes")]
    flags = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[:len(p)] for x, p in zip(group.column("several"), parts)]
    _, nth, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    several = np.zeros(len(count), bool)
    np.logical_or.at(several, nth, np.concatenate(flags).astype(bool))
    shared = (several | (count > 1))[nth]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"),
                     "bits": pa.array([np.packbits(x).tobytes() for x in np.split(shared, cuts)], pa.binary())})


def _forms(buckets: int):
    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for record in records:
            for row in _rows(record):
                b = Batch(row, buckets)
                b.keep(row["answers"])
                out = {"batch": [], "bucket": [], "docs": [], "around": []}
                for bucket, part in _stretches(b.form_bucket):
                    out["batch"].append(row["batch"])
                    out["bucket"].append(bucket)
                    out["docs"].append(b.form_doc[part].tobytes())
                    out["around"].append(pack.compress(b.around[part].tobytes() + b.form_before[part].astype(np.uint8).tobytes()
                                                       + b.form_after[part].astype(np.uint8).tobytes()))
                yield pa.RecordBatch.from_pydict(out, schema=_FORM)
    return run


_FORM = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("docs", pa.binary()), ("around", pa.binary())])


def _order(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows, and for each but the first its common prefix with the row before."""
    n, width = columns.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = columns
    words = wide.view(">u8")
    order = np.lexsort(words.T[::-1])
    rows = columns[order]
    differ = rows[1:] != rows[:-1]
    return order, np.where(differ.any(axis=1), differ.argmax(axis=1), width)


def earlier_strings(around: np.ndarray, before: np.ndarray, after: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Bit l of each surroundings: the string from l bytes before the trigger occurs in a smaller document."""
    n = len(docs)
    masks = np.zeros(n, np.uint32)
    trigger = around[:, REACH:REACH + WIDTH]
    by_left, left_prefix = _order(np.concatenate([trigger, around[:, :REACH][:, ::-1]], axis=1))
    by_right, right_prefix = _order(around[:, REACH:])

    def ranks(order, prefix, depth):
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(prefix < depth)])
        return rank
    for left in range(REACH + 1):
        fits = np.flatnonzero((before >= left) & (after >= REACH - left))
        if len(fits) < 2:
            continue
        pair = (ranks(by_left, left_prefix, WIDTH + left)[fits] * n
                + ranks(by_right, right_prefix, WIDTH + REACH - left)[fits])
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        begin = np.concatenate([[True], pair[1:] != pair[:-1]])
        least = np.minimum.reduceat(docs[fits][order], np.flatnonzero(begin))[np.cumsum(begin) - 1]
        gone = fits[order[least < docs[fits][order]]]
        masks[gone] |= np.uint32(1 << left)
    return masks


def _answer(group: pa.Table) -> pa.Table:
    """One bucket of pass 2."""
    docs = [np.frombuffer(x.as_py(), np.int64) for x in group.column("docs")]
    unpack = zstandard.ZstdDecompressor()
    around, before, after = [], [], []
    for packed, d in zip(group.column("around"), docs):
        raw = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
        n = len(d)
        around.append(raw[:n * AROUND].reshape(n, AROUND))
        before.append(raw[n * AROUND:n * (AROUND + 1)])
        after.append(raw[n * (AROUND + 1):])
    masks = earlier_strings(np.concatenate(around), np.concatenate(before).astype(np.int64),
                            np.concatenate(after).astype(np.int64), np.concatenate(docs))
    cuts = np.cumsum([len(d) for d in docs])[:-1]
    return pa.table({"batch": group.column("batch"), "bucket": group.column("bucket"),
                     "bits": pa.array([x.tobytes() for x in np.split(masks, cuts)], pa.binary())})


def removed_bytes(b: Batch, masks: np.ndarray) -> np.ndarray:
    """Which bytes of the batch go, from the masks of its distinct surroundings."""
    whole = np.zeros(len(b.forms), np.uint32)
    for left in range(REACH + 1):
        whole |= (((b.form_before >= left) & (b.form_after >= REACH - left)).astype(np.uint32) << np.uint32(left))
    later = b.docs[b.owner] > b.form_doc[b.form]
    mask = np.where(later, whole[b.form], masks[b.form]) if len(b.form) else np.zeros(0, np.uint32)
    starts = np.zeros(len(b.data) + 1, bool)
    for left in range(REACH + 1):
        starts[b.place[(mask >> np.uint32(left)) & np.uint32(1) == 1] - left] = True
    step = np.zeros(len(b.data) + LENGTH + 1, np.int64)
    at = np.flatnonzero(starts)
    step[at] += 1
    step[at + LENGTH] -= 1
    return np.cumsum(step)[:len(b.data)] > 0


def _apply(buckets: int):
    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in records:
            for row in _rows(record):
                b = Batch(row, buckets)
                b.keep(row["answers"])
                masks = np.zeros(len(b.forms), np.uint32)
                bits = {a["bucket"]: a["bits"] for a in row["masks"] or []}
                for bucket, part in _stretches(b.form_bucket):
                    masks[part] = np.frombuffer(bits[bucket], np.uint32)
                gone = removed_bytes(b, masks)
                out = {"d": b.docs.tolist(), "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
                for a, e in zip(b.starts, b.ends):
                    dead = gone[a:e]
                    kept = b.data[a:e][~dead].tobytes()
                    out["n_removed"].append(int(dead.sum()))
                    out["n_spans"].append(int(dead[:1].sum() + (dead[1:] & ~dead[:-1]).sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(hashlib.md5(b.data[a:e].tobytes()).digest())
                yield pa.RecordBatch.from_pydict(out, schema=_DONE)
    return run


_DONE = pa.schema([("d", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                   ("kept", pa.binary())])


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), ordered_id(id_col).alias("d"), text.cast("binary").alias("data"))
    rows = store(d.select("id", "d", F.length("data").cast("long").alias("n_bytes"), F.unhex(F.md5("data")).alias("content")), "rows")
    first = rows.groupBy("content").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    copies = few(store(rows.join(first, "content").where("d > first").select("d", "content").distinct(), "copies"))
    own = d.withColumn("content", F.unhex(F.md5("data"))).join(copies, ["d", "content"], "left_anti").select("d", "data")
    name = f"corpus_{uuid.uuid4().hex}"
    (own.mapInArrow(_batches, "batch long, docs array<long>, sizes array<long>, data binary")
     .write.bucketBy(buckets, "batch").option("path", fresh_path(spark, "corpus")).option("compression", "zstd").saveAsTable(name))
    corpus = spark.table(name)

    def by_batch(answers: DataFrame, alias: str) -> DataFrame:
        return answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "bits")).alias(alias))

    bits = "batch long, bucket long, bits binary"
    shared = store(corpus.mapInArrow(_asks(buckets), "batch long, bucket long, hashes binary, several binary")
                   .groupBy("bucket").applyInArrow(_shared, bits), "shared")
    asked = corpus.join(by_batch(shared, "answers"), "batch", "left")
    masks = store(asked.mapInArrow(_forms(buckets), "batch long, bucket long, docs binary, around binary")
                  .groupBy("bucket").applyInArrow(_answer, bits), "masks")
    done = asked.join(by_batch(masks, "masks"), "batch", "left").mapInArrow(
        _apply(buckets), "d long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    done = done.withColumnRenamed("kept", "content").dropDuplicates(["d", "content"])
    out = rows.join(done, ["d", "content"], "left")
    copy = F.col("n_removed").isNull()
    # A copy loses everything, unless it is shorter than the strings compared.
    short = copies.join(d.where(F.length("data") < LENGTH).withColumn("content", F.unhex(F.md5("data"))), ["d", "content"])
    short = short.select("d", "content", F.sha2("data", 256).alias("own")).distinct()
    out = out.join(short, ["d", "content"], "left")
    lost = copy & (F.col("n_bytes") >= LENGTH)
    return out.select(
        F.col("id").alias(id_col), "n_bytes", F.when(lost, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(lost, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(lost, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", "own")).alias("kept_sha256"))
