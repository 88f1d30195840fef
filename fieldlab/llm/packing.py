"""Packs documents into as few sequences as possible by a configuration linear program.

Tasks tokenize whole texts and cut only documents longer than a sequence. The
histogram of piece lengths (at most ``capacity`` counts, so bounded) goes to the
driver, which solves the covering program over configurations (multisets of
lengths that fit) by multiplicative weights: a knapsack table prices all
configurations, near-optimal ones get a step, covered lengths lose weight. The
solution is rounded to whole configurations and pieces left over are packed
best-fit on the histogram. Tasks then place each piece by its rank among pieces
of its length.

Nulls and empty texts are one piece with the end mark. Every input row is a
document of its own; a null id stays null. Other columns are not read.
"""

from __future__ import annotations

import base64
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

CAPACITY = 2048
END_ID = 0
STEP = 0.5
SLACK = 0.3
CACHED_WORDS = 700_000


class WordIds(dict):
    """Ids of space-separated words, each with the space before it, as little-endian bytes; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = array("I", self.encode(" " + word)).tobytes()
        return ids


def encoder(path: str = "", ranks: str = ""):
    """text -> bytes of the ids that the tokenizer file gives.

    Ids come from the same vocabulary as ranks, which is several times faster. The
    vocabulary never joins a character with a single space after it, so words can
    be looked up one by one; texts with wider gaps go in whole, and those that
    spell a special token go to the tokenizer of the file itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        merges = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                              special_tokens={}).encode_ordinary
    cache = WordIds(plain)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if "  " in text:
            return array("I", plain(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", plain(first)).tobytes() + b"".join(map(cache.__getitem__, rest))
    return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, length, capacity)]


def _pieces(path: str, ranks: str, capacity: int, end_id: int):
    end = np.asarray([end_id], "<u4").tobytes()
    held = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(encoder(path, ranks))
        seen: Counter = Counter()
        task = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("id"), batch.column("text")):
                ids = held[0](text.as_py()) + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, n, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.as_py() for x in columns[0]], batch.schema.field("id").type)]
                + [pa.array(c, t) for c, t in zip(columns[1:], [pa.int32()] + [pa.int64()] * 5)],
                names=["id", "piece", "start", "length", "ids_crc32", "task", "nth"])
    return run


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int], list[int]]:
    """Best price of each room, the length to take first there (the longest among ties), and the room that is put to use."""
    best, take, used = np.zeros(capacity + 1), [0] * (capacity + 1), [0] * (capacity + 1)
    down, worth = lengths[::-1], prices[::-1]
    starts = len(down) - np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], used[c] = best[c - 1], used[c - 1]
        start = starts[c]
        if start < len(down):
            values = best[c - down[start:]] + worth[start:]
            i = int(values.argmax())
            if values[i] > best[c]:
                best[c], take[c], used[c] = values[i], int(down[start + i]), c
    return best, take, used


def _fill(room: int, take: list[int], used: list[int]) -> list[int]:
    """Lengths of an optimal configuration in ``room``."""
    items, room = [], used[room]
    while room:
        items.append(take[room])
        room = used[room - take[room]]
    return items


def configurations(counts: np.ndarray, capacity: int, step: float = STEP, slack: float = SLACK) -> dict[tuple, float]:
    """Fractional cover of the histogram by multiplicative weights: configuration -> times used.

    A length's weight starts as its tokens and shrinks by exp(-share covered). Each
    round one knapsack table gives the best configuration through every length;
    those within ``slack`` of the best of all get a step. Rounds go on until every
    length is covered; one that adds nothing would be the last, since it would repeat.
    """
    used: dict[tuple, float] = {}
    covered, demand = np.zeros(capacity + 1), counts.astype(float)
    wanted = np.flatnonzero(counts)
    added = True
    while added:
        added = False
        share = covered[wanted] / demand[wanted]
        open_, share = wanted[share < 1 - 1e-9], share[share < 1 - 1e-9]
        if not len(open_):
            break
        prices = open_ * np.exp(-share)
        best, take, full = knapsack(open_, prices, capacity)
        near = prices + best[capacity - open_] >= (1 - slack) * best[capacity]
        for v in map(int, open_[near][::-1]):
            config = Counter([v] + _fill(capacity - v, take, full))
            amount = min(step * demand[v], *((demand[u] - covered[u]) / n for u, n in config.items()))
            if amount <= 1e-9 * demand[v]:
                continue
            added = True
            key = tuple(sorted(config.items(), reverse=True))
            used[key] = used.get(key, 0.0) + amount
            for u, n in config.items():
                covered[u] += amount * n
    return used


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on the histogram: (configuration, times)."""
    groups: dict[int, list[tuple[tuple, int]]] = {}
    for v in np.flatnonzero(counts)[::-1]:
        v, left = int(v), int(counts[v])
        for room in sorted(r for r in groups if r >= v):
            while left and groups.get(room):
                config, times = groups[room].pop()
                q = min(room // v, left)
                t = min(times, left // q)
                if times > t:
                    groups[room].append((config, times - t))
                groups.setdefault(room - q * v, []).append((config + ((v, q),), t))
                left -= t * q
            if not left:
                break
        if left:
            q = min(capacity // v, left)
            groups.setdefault(capacity - q * v, []).append((((v, q),), left // q))
            if left % q:
                groups.setdefault(capacity - left % q * v, []).append((((v, left % q),), 1))
    return [g for room in sorted(groups) for g in groups[room]]


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple, int]]:
    """Whole configurations covering the histogram exactly.

    The program is rounded down; then configurations are taken once more by
    falling fraction while their pieces last; best fit packs the rest.
    """
    left, plan = counts.astype(np.int64).copy(), Counter()
    cover = configurations(counts, capacity)
    by_fraction = sorted(cover, key=lambda c: (-(cover[c] % 1), c))
    for order, wish in ((cover, lambda c: int(cover[c] + 1e-9)), (by_fraction, lambda c: 1)):
        for config in order:
            times = min([wish(config)] + [int(left[v] // n) for v, n in config])
            if times > 0:
                plan[config] += times
                for v, n in config:
                    left[v] -= n * times
    return list(plan.items()) + best_fit(left, capacity)


def slots(plan: list[tuple[tuple, int]], capacity: int) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces of it in a sequence, first sequence, first offset), by rank."""
    rows: dict[int, list] = {}
    ranks: Counter = Counter()
    sequence = 0
    for config, times in plan:
        offset = 0
        for v, a in config:
            rows.setdefault(v, []).append((ranks[v], a, sequence, offset))
            ranks[v] += a * times
            offset += a * v
        sequence += times
    return {v: np.array(r, np.int64) for v, r in rows.items()}


def _place(places: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                rows = places[int(v)]
                row = rows[np.searchsorted(rows[:, 0], rank[mine], "right") - 1]
                nth = rank[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + nth // row[:, 1]
                offset[mine] = row[:, 3] + nth % row[:, 1] * v
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(sequence), pa.array(offset)],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   end_id: int = END_ID, tokenizer_path: str = "", ranks_path: str = "") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(d.dtypes)["id"]
    pieces = store(d.mapInArrow(
        _pieces(tokenizer_path, ranks_path, capacity, end_id),
        f"id {kind}, piece int, start long, length long, ids_crc32 long, task long, nth long"), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    places = slots(solve(counts, capacity), capacity)
    ranked = pieces.join(base, ["length", "task"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(
        _place(places), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("id", id_col)
