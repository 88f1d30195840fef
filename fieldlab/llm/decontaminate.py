"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Items are normalised to lower-case words; each run of ``window`` consecutive
words (or a whole shorter item) is a pattern bounded by spaces. A document is
scanned once; matches are mapped back to code points of the original text. The
benchmark is sent to the executors in shards of at most ``shard_chars``
characters of patterns, each scanned in its own pass, so what a task holds is
bounded for any benchmark; the usual one is a single shard.

A null or empty text has no words and is not contaminated. An item without words
matches nothing; an item with a null id is listed as the empty string. Equal
items all count. Every input row gives one row. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

WINDOW = 13
SHARD_CHARS = 20_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = str.maketrans(UPPER, LOWER)


def normal_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(_LOWER))


def item_windows(text: str, window: int = WINDOW) -> set[str]:
    words = normal_words(text)
    if not words:
        return set()
    return {f" {' '.join(words[i:i + window])} " for i in range(max(1, len(words) - window + 1))}


def automaton(items: list[tuple[str, str]], window: int = WINDOW):
    """Patterns -> (number of words, items that hold the pattern)."""
    import ahocorasick
    holders: dict[str, list[int]] = {}
    for n, (_, text) in enumerate(items):
        for pattern in item_windows(text, window):
            holders.setdefault(pattern, []).append(n)
    machine = ahocorasick.Automaton()
    for pattern, numbers in holders.items():
        machine.add_word(pattern, (pattern.count(" ") - 1, tuple(numbers)))
    if holders:
        machine.make_automaton()
    return machine, bool(holders)


def scan(text: str, machine, usable: bool) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, runs of hit words [from, to), items with occurring windows."""
    words = normal_words(text)
    hits: list[tuple[int, int]] = []
    found: set[int] = set()
    if usable and words:
        joined = f" {' '.join(words)} "
        ends = list(machine.iter(joined))
        if ends:
            at, seen = 0, 0
            for end, (length, numbers) in ends:
                seen += joined.count(" ", at, end + 1)
                at = end + 1
                last = seen - 1  # words that ended before this space
                hits.append((last - length, last))
                found.update(numbers)
    runs: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return len(words), runs, found


def _pass(items: list[tuple[str, str]], window: int):
    """Adds what one shard of the benchmark finds to the runs and items of each row."""
    built = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(automaton(items, window))
        machine, usable = built[0]
        for batch in batches:
            words, runs, named = [], [], []
            for row in batch.to_pylist():
                n, hit, found = scan(row["text"], machine, usable)
                words.append(n)
                runs.append(row["runs"] + [{"a": a, "b": b} for a, b in hit])
                named.append(row["items"] + [items[i][0] for i in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array(words, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                 pa.array(named, pa.list_(pa.string()))], names=["id", "text", "n_words", "runs", "items"])
    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge runs of all shards and map word runs to code points of the text."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            runs: list[list[int]] = []
            for a, b in sorted((r["a"], r["b"]) for r in row["runs"]):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            spans = ""
            if runs:
                place = [m.span() for m in re.finditer(WORD, row["text"].translate(_LOWER))]
                spans = ",".join(f"{place[a][0]}:{place[b - 1][1]}" for a, b in runs)
            n_hit = sum(b - a for a, b in runs)
            named = sorted(row["items"])
            out.append((row["id"], row["n_words"], n_hit, len(named),
                        hashlib.sha256(",".join(named).encode()).hexdigest(),
                        n_hit > 0 and 20 * n_hit >= row["n_words"], spans))
        columns = list(zip(*out)) if out else [[]] * 7
        types = [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                         names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


def shards(benchmark: DataFrame, item_col: str, text_col: str, shard_chars: int):
    """Yield lists of (item id, text) of bounded size; the driver holds one list at a time."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in rows.toLocalIterator():
        chars = len(row["t"] or "") * WINDOW
        if part and size + chars > shard_chars:
            yield part
            part, size = [], 0
        part.append((row["i"] or "", row["t"] or ""))
        size += chars
    yield part


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                   shard_chars: int = SHARD_CHARS) -> DataFrame:
    """One row per input row: n_words, n_hit, n_items, items_sha256, contaminated, spans of hit code points."""
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(d.dtypes)["id"]
    at = d.select("id", "text", F.lit(0).cast("long").alias("n_words"),
                  F.array().cast("array<struct<a:long,b:long>>").alias("runs"),
                  F.array().cast("array<string>").alias("items"))
    for part in shards(benchmark, item_col, item_text_col, shard_chars):
        at = at.mapInArrow(_pass(part, window), at.schema)
    return at.mapInArrow(
        _digest, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    ).withColumnRenamed("id", id_col)
