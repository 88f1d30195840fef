"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Words are lower-case runs of letters, marks and digits; k-mers are five
consecutive words (all words of a shorter text), labelled with their occurrence
number. Each of ``sketches`` permutations picks the ``picks`` smallest labelled
k-mers and keeps them in text order; texts that agree on one pick are
candidates. With 28 sketches of 5 picks, a pair sharing 0.8 of its k-mers is
missed with probability below 4e-5 if both texts have 40 k-mers or more. Picks
are without replacement, so fewer k-mers would miss more; texts that may share 0.8
with one of under 40 also have their smallest k-mers as keys, as many as make sure
that such a pair shares one. A candidate is a link if the word edit
similarity, 1 - distance / longer length, is ``similarity`` or more; the distance
comes from an alignment inside the band that this bound leaves.

Copies (equal words) collapse into their smallest id before anything else. In a
bucket each text is aligned with the bucket's head, its smallest id, and texts
unlike the head with a second head, the smallest id among themselves. Where more than
one class is left after that, the rest is split by content: what such texts share
with the head, most of it a template that many texts hold, can't tell them apart, so
each is sketched once more over the k-mers that the head lacks, and the keys, which
hold for members of that head only, make smaller buckets with heads of their own;
and so on until no bucket has two classes left that have not met. No round makes more
than ``rest_sketches`` rows of a text and a head it has met, and no bucket is taken
pair by pair. Classes are the connected components.

A null text counts as empty; texts without words are copies of each other. A node
of the graph is an id with the hash of the words, so different texts that share an
id, or have none, are documents of their own; a null id counts as the largest id.
Every input row gives one row. Only the two named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, few, let, ordered_id, store

KMER = 5
SIMILARITY = 0.8
SKETCHES = 28
PICKS = 5
SHORT = 40
REST_SKETCHES = 10
REST_PICKS = 2
_NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"
_WIDTH = 4_000_000  # hashes computed at once


def text_words(text: Column) -> Column:
    return let(F.split(F.lower(text), _NOT_WORD), lambda w: F.filter(w, lambda x: x != ""))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-mers, each labelled with its occurrence number."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    in_order = h[order]
    same = np.flatnonzero(in_order[1:] == in_order[:-1]) + 1
    if len(same):
        first = np.ones(n, bool)
        first[same] = False
        starts = np.flatnonzero(first)
        nth = np.arange(n) - starts[np.cumsum(first) - 1]
        labelled = _mix(in_order[same] + nth[same].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        h[order[same]] = labelled  # first occurrences keep their hash, so texts without repeats have the same one
    return h


def order_minhash(h: np.ndarray, seeds: np.ndarray, picks: int) -> np.ndarray:
    """One key per permutation: its smallest k-mers, in text order."""
    n, out = len(h), np.zeros(len(seeds), np.uint64)
    take = min(picks, n)
    rows = max(1, _WIDTH // n)
    for a in range(0, len(seeds), rows):
        some = seeds[a:a + rows]
        ranks = (h[None, :] ^ some[:, None]) * np.uint64(0xFF51AFD7ED558CCD)
        ranks ^= ranks >> np.uint64(32)
        ranks *= np.uint64(0xC4CEB9FE1A85EC53)
        spots = np.argpartition(ranks, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(some), 1))
        spots = np.sort(spots, axis=1)
        key = some.copy()
        for i in range(take):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + h[spots[:, i]])
        out[a:a + rows] = key
    return out


def prefix_keys(h: np.ndarray, similarity: float) -> np.ndarray:
    """Smallest k-mers of a short text: two sets that share ``similarity`` of their union share one of them for certain."""
    least = np.sort(h)[:int((1 - similarity) * len(h) + 1e-9) + 1]
    return _mix(least ^ np.uint64(0xA0761D6478BD642F))


def _sketch(k: int, sketches: int, picks: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            words = batch.column("words")
            ends = words.offsets.to_numpy()
            flat = words.values.to_numpy().view(np.uint64)
            keys = []
            for a, b in zip(ends[:-1], ends[1:]):
                h = kmers(flat[a:b], k)
                key = order_minhash(h, seeds, picks) if len(h) else np.zeros(0, np.uint64)
                if 0 < similarity * len(h) < SHORT:
                    key = np.concatenate([key, prefix_keys(h, similarity)])
                keys.append(key.view(np.int64))
            sizes = np.diff(ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), batch.column("d"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), words],
                names=["id", "h", "d", "n", "keys", "words"])
    return run


class _Prefix:
    """Hashes of all stretches of a word sequence."""

    def __init__(self, words: np.ndarray, power: np.ndarray):
        self.power = power
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words.astype(np.uint64) + np.uint64(1)) * power[:len(words)])])

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return self.sums[start + length] - self.sums[start]


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Word edit distance if it is at most ``most``, else None.

    Keeps, for each diagonal of the band, the furthest row reached with e edits;
    equal stretches are skipped by comparing stretch hashes.
    """
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    longest = max(len(a), len(b))
    power = np.cumprod(np.full(longest + 1, 0x9E3779B97F4A7C15, np.uint64))
    pa_, pb = _Prefix(a, power), _Prefix(b, power)
    top = 1 << (n - 1).bit_length() if n > 1 else 1

    def extend(i: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        i = i.copy()
        j = i + diagonal
        step = top
        while step:
            fits = np.flatnonzero((i + step <= len(a)) & (j + step <= len(b)))
            if len(fits):
                x, y = i[fits], j[fits]
                same = fits[pa_.of(x, step) * power[y] == pb.of(y, step) * power[x]]
                i[same] += step
                j[same] += step
            step >>= 1
        return i

    goal = len(b) - len(a)
    at = np.full(2 * most + 3, -1, np.int64)  # diagonal g is at most + 1 + g
    mid = most + 1
    at[mid] = extend(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for e in range(most + 1):
        if at[mid + goal] >= len(a):
            return e
        if e == most:
            return None
        low, high = max(-(e + 1), goal - (most - e - 1), -most), min(e + 1, goal + (most - e - 1), most)
        if low > high:
            return None
        g = np.arange(low, high + 1)
        here, left, right = at[mid + g], at[mid + g - 1], at[mid + g + 1]
        new = np.maximum(np.where(here >= 0, here + 1, -1), np.maximum(left, np.where(right >= 0, right + 1, -1)))
        valid = new >= 0
        new = np.where(valid, np.minimum(np.minimum(new, len(a)), len(b) - g), -1)
        valid = (new >= 0) & (new + g >= 0)
        new[~valid] = -1
        if valid.any():
            new[valid] = extend(new[valid], g[valid])
        at = np.full(2 * most + 3, -1, np.int64)
        at[mid + g] = new
    return None


def is_near(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sequences of hashed words have that edit similarity."""
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    numbers = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    x, y = numbers[:len(a)], numbers[len(a):]
    size = numbers.max() + 1
    shared = np.minimum(np.bincount(x, minlength=size), np.bincount(y, minlength=size)).sum()
    if longest - shared > most:  # each edit mends one word at most
        return False
    return banded_distance(x, y, most) is not None


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [is_near(x, y, similarity) for x, y in zip(_lists(batch.column("x")), _lists(batch.column("y")))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))
    return run


def rest_keys(text: np.ndarray, head: np.ndarray, k: int, seeds: np.ndarray, picks: int) -> np.ndarray:
    """Keys of a text over the k-mers that the head lacks, or over all if hardly any is left."""
    own = kmers(text.view(np.uint64), k)
    rest = own[~np.isin(own, kmers(head.view(np.uint64), k))]
    return order_minhash(rest if 10 * len(rest) >= len(own) else own, seeds, picks)


def _rest(k: int, sketches: int, picks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _mix(np.arange(1001, sketches + 1001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            keys = []
            for head, x, y in zip(batch.column("head").to_pylist(), _lists(batch.column("x")), _lists(batch.column("y"))):
                scope = np.frombuffer(head[-8:], np.uint64)
                keys.append(_mix(rest_keys(x, y, k, seeds, picks) ^ scope).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "n", "c")] + [pa.array(keys, pa.list_(pa.int64()))],
                                             names=["d", "n", "c", "keys"])
    return run


def _node(d: Column, md5: Column) -> Column:
    """24 bytes in the order of the id, then of the hash of the words."""
    return F.unhex(F.concat(F.lpad(F.hex(d.bitwiseXOR(F.lit(-2 ** 63))), 16, "0"), md5))


def _node_id(node: Column) -> Column:
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-2 ** 63))


def components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star steps on edges (u > v): rows (u, smallest member)."""
    at, before = store(edges.select("u", "v").distinct(), "edges"), None
    while True:
        both = at.union(at.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = store(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return after
        at, before = after, mark


def _by_content(left: DataFrame, tried: DataFrame, texts: DataFrame, verified, k: int, similarity: float,
                sketches: int, picks: int) -> DataFrame | None:
    """Links of texts unlike their bucket's heads: left has (d, n, c: class so far, head: the last one met)."""
    links, left = None, store(left, "left")
    split = left.select("d", "head")
    while not left.isEmpty():
        both = (left.join(texts.select("d", F.col("t").alias("x")), "d")
                .join(texts.select(F.col("d").alias("head"), F.col("t").alias("y")), "head"))
        rows = store(both.mapInArrow(_rest(k, sketches, picks), "d binary, n long, c binary, keys array<long>"), "rest-keys")
        rows = rows.select("d", "n", "c", F.explode("keys").alias("key"))
        heads = (rows.groupBy("key").agg(F.min(F.struct("d", "n", "c")).alias("first"), F.count("*").alias("m"),
                                         F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key", "first", "m"))
        met = (rows.join(heads, "key").where((F.col("d") != F.col("first.d")) & (F.col("c") != F.col("first.c")))
               .groupBy("d", "n", "c", F.col("first.d").alias("head"), F.col("first.n").alias("head_n")).agg(F.max("m").alias("m")))
        met = store(met, "met")
        fits = F.least("n", "head_n") >= similarity * F.greatest("n", "head_n") - 1e-9
        fresh = store(met.where(fits).select(F.col("d").alias("a"), F.col("head").alias("b")).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = verified(fresh)
        tried, links = tried.union(fresh), found if links is None else links.union(found)
        unlike = met.where("m > 2").join(links.select(F.col("a").alias("d"), F.col("b").alias("head")), ["d", "head"], "left_anti")
        left = store(unlike.join(split, ["d", "head"], "left_anti").select("d", "n", "c", "head"), "left")
        split = split.union(left.select("d", "head"))
    return links


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = KMER,
                 similarity: float = SIMILARITY, sketches: int = SKETCHES, picks: int = PICKS,
                 rest_sketches: int = REST_SKETCHES, rest_picks: int = REST_PICKS, version: str = "") -> DataFrame:
    """One row per input row: id, group_id (smallest id of its class) and kept (it has that id and its words);
    if ``version`` is named, also a struct of ordered id and text hash by which rows can be told apart."""
    named = docs.select(F.col(id_col).alias("id"), ordered_id(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = named.select("id", F.xxhash64("text").alias("h"), "d", text_words(F.col("text")).alias("w"))
    named = named.select("id", "h", _node(F.col("d"), F.md5(F.array_join("w", " "))).alias("d"), "w")
    hashed = named.select("id", "h", "d", F.transform("w", lambda x: F.xxhash64(x)).alias("words"))
    kind = dict(named.dtypes)["id"]
    table = store(hashed.mapInArrow(_sketch(k, sketches, picks, similarity),
                                    f"id {kind}, h long, d binary, n long, keys array<long>, words array<long>"), "sketches")
    contents = table.select("d", F.substring("d", 9, 16).alias("content"))
    several = store(contents.groupBy("content").agg(F.min("d").alias("first"), F.max("d").alias("last"))
                    .where("first < last").select("content", "first"), "several")
    copies = store(contents.join(few(several), "content").where("d > first").select("d", "first").distinct(), "copies")
    rows = (table.join(few(copies), "d", "left_anti")
            .select("d", "n", F.explode("keys").alias("key")))
    least = F.min(F.struct("d", "n"))
    heads = rows.groupBy("key").agg(least.alias("head"), F.max("d").alias("last")).where("head.d < last").select("key", "head")
    buckets = store(rows.join(heads, "key").where(F.col("d") != F.col("head.d")).select("key", "d", "n", "head").distinct(), "buckets")
    asked = buckets.select("d").union(buckets.select("head.d")).distinct()
    texts = table.join(few(store(asked, "bucketed")), "d").groupBy("d").agg(F.first("words").alias("t"))
    texts = store(texts, "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(texts.select(F.col("d").alias("a"), F.col("t").alias("x")), "a")
                .join(texts.select(F.col("d").alias("b"), F.col("t").alias("y")), "b"))
        return store(both.mapInArrow(_verify(similarity), "a binary, b binary").distinct(), "links")

    def paired(members: DataFrame) -> DataFrame:
        fits = F.least("n", "head.n") >= similarity * F.greatest("n", "head.n") - 1e-9
        return members.where(fits).select(F.col("d").alias("a"), F.col("head.d").alias("b")).distinct()
    pairs = store(paired(buckets), "pairs")
    links = verified(pairs)
    # Members that are not like their bucket's head get a head of their own.
    left = buckets.select("key", "d", "n", F.col("head.d").alias("h"))
    left = left.join(few(links.select(F.col("a").alias("d"), F.col("b").alias("h"))), ["d", "h"], "left_anti").select("key", "d", "n")
    left = store(left, "left")
    heads = left.groupBy("key").agg(least.alias("head"), F.max("d").alias("last")).where("head.d < last").select("key", "head")
    seconds = store(left.join(heads, "key").where(F.col("d") != F.col("head.d")), "seconds")
    more = store(paired(seconds).join(pairs, ["a", "b"], "left_anti"), "pairs")
    tried, links = pairs.union(more), links.union(verified(more))

    def linked(found: DataFrame) -> DataFrame:
        edges = found.toDF("u", "v").union(copies.select(F.col("d").alias("u"), F.col("first").alias("v")))
        return store(components(edges).select(F.col("u").alias("d"), F.col("v").alias("group")), "classes")
    classes = linked(links)
    # Members unlike both heads, each with its class so far, of buckets with more than one class left.
    far = seconds.select("key", "d", "n", F.col("head.d").alias("h"))
    far = far.join(few(links.select(F.col("a").alias("d"), F.col("b").alias("h"))), ["d", "h"], "left_anti")
    far = store(far.join(few(classes), "d", "left").select("key", "d", "n", F.col("h").alias("head"), F.coalesce("group", "d").alias("c")), "left")
    open_ = far.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    far = far.join(open_, "key", "left_semi").select("d", "n", "c", "head").distinct()
    later = _by_content(far, tried, texts, verified, k, similarity, rest_sketches, rest_picks)
    if later is not None:
        classes = linked(links.union(later))
    out = table.select("id", "h", "d").join(few(classes), "d", "left").withColumn("group", F.coalesce("group", "d"))
    out = out.withColumn("first", _node_id(F.col("group")))
    told = [F.struct(ordered_id("id").alias("d"), "h").alias(version)] if version else []
    return out.select(F.col("id").alias(id_col), F.when(F.col("first") != LAST_ID, F.col("first")).alias("group_id"),
                      (F.col("group") == F.col("d")).alias("kept"), *told)
