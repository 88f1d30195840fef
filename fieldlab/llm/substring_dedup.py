"""Repeated runs of sentences across the corpus.

A sentence ends at a run of . ! ? or line breaks; words are runs of letters and
digits. Sentences are cut into pieces at places that the words themselves choose:
of every ``window`` neighbouring pairs of words the one with the smallest hash is a
place. From each piece on, and up to each end of a sentence, the shortest run of
consecutive pieces with at least ``least_words`` words is hashed over its lower-case
words; equal runs are joined globally; in all but the first (smallest id, then place)
every piece goes.

Places of a passage depend on its own words only, but for those within ``window`` of
its ends. So any two texts that share 4 x window - 2 + ``least_words`` words, cut
anywhere, share a run (51 words by default). A passage that starts and ends with
sentences goes whole; of others a few words may stay at either end.

Hashes are two independent 64-bit ones. The first finds runs that occur twice; only
those carry their places on, and both hashes decide. Texts are cut many at a time on
arrays of code points; a text of any length is cut whole.

A null or empty text has no sentences. Rows sharing an id are one document; a
null id counts as the largest. Every input row gives one row. Only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordered_id, store

LEAST_WORDS = 25
WINDOW = 7
CHUNK = 1 << 18  # characters cut at once, or one longer text; bounds what a worker holds beside its batch
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_TERMINATORS = ".!?\n"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 in words, 2 at ends of sentences, else 0; and a hash of its lower case."""
    kinds, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            kinds[i] = 1
            small = c.lower()
            if small != c and len(small) == 1:
                lower[i] = ord(small)
    kinds[[ord(c) for c in _TERMINATORS]] = 2
    return kinds, _mix(lower + np.uint64(1))


def _new_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64))) for b in (base, pow(base, -1, 2 ** 64)))


_kept_powers = cache(_new_powers)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, n or more; those for a text beyond ``CHUNK`` are not kept."""
    return _kept_powers(base, 2 * CHUNK) if n <= 2 * CHUNK else _new_powers(base, n)


def _stretches(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Hash of each stretch of values, wherever it stands."""
    up, down = _powers(base, len(values))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:len(values)])])
    return _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


class Cut:
    """Pieces and runs of some texts.

    ``at`` are the first words of pieces (all words numbered through) and a last
    bound; ``start`` and ``stop`` the bounds of each run as places in ``at``, and
    ``runs_upto`` the number of runs before each text.
    """

    def __init__(self, texts: list[str], least_words: int = LEAST_WORDS, window: int = WINDOW):
        kinds, codes = _characters()
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # where each text starts
        kind = kinds[points]
        edge = np.diff((kind == 1).astype(np.int8), prepend=0, append=0)
        self.first, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(self.first)
        self.text = np.searchsorted(self.base, self.first, "right") - 1
        ends = kind == 2
        if len(texts) > 1:
            ends[self.base[1:-1] - 1] = False  # between texts
        self.ended = np.concatenate([[0], np.cumsum(ends)])
        # a sentence is over where a terminator is followed by none
        over = ends & ~np.append(ends[1:], False)
        self.over = np.concatenate([[0], np.cumsum(over)])
        words = _stretches(codes[points], self.first, self.end, _BASES[0])
        fresh = np.ones(n, bool)
        fresh[1:] = self.text[1:] != self.text[:-1]
        self.breaks = fresh.copy()
        self.breaks[1:] |= self.ended[self.first[1:]] > self.ended[self.end[:-1]]
        places = self.breaks.copy()
        if n > window:
            pairs = _mix(words[:-1] * np.uint64(_BASES[1]) + words[1:])  # the pair before word k + 1
            views = np.lib.stride_tricks.sliding_window_view(pairs, window)
            spot = np.arange(len(views)) + views.argmin(axis=1) + 1
            places[spot[self.text[:len(views)] == self.text[window:window + len(views)]]] = True
        self.at = np.append(np.flatnonzero(places), n)
        words_upto = np.searchsorted(self.text, np.arange(len(texts) + 1))
        begin, stop = self.at[:-1], self.at[1:]
        on = np.flatnonzero(begin + least_words <= words_upto[self.text[begin] + 1])
        to = np.searchsorted(self.at, begin[on] + least_words)
        sentence = np.append(self.breaks, True)[stop]  # pieces that end a sentence
        back = np.flatnonzero(sentence & (stop - least_words >= words_upto[self.text[begin]]))
        since = np.searchsorted(self.at, stop[back] - least_words, "right") - 1
        runs = np.unique(np.append(on, since) * len(self.at) + np.append(to, back + 1))  # by start, then stop
        self.start, self.stop = runs // len(self.at), runs % len(self.at)
        self.runs_upto = np.searchsorted(self.text[begin[self.start]], np.arange(len(texts) + 1))
        second = _mix(words ^ np.uint64(_BASES[1]))
        a, b = self.at[self.start], self.at[self.stop]
        self.hashes = [_stretches(w, a, b, base).view(np.int64) for w, base in zip((words, second), _BASES)]

    def places(self) -> np.ndarray:
        """Where in its text each bound of ``at`` but the last stands."""
        k = self.at[:-1]
        text = self.text[k]
        floor = np.where((k > 0) & (self.text[k - 1] == text), self.end[k - 1], self.base[text])
        spots = np.flatnonzero(np.diff(self.ended))
        ended = self.ended[self.first[k]]
        after = np.where(ended > 0, (spots[np.maximum(ended - 1, 0)] if len(spots) else 0) + 1, 0)
        own = np.where(after > floor, after, np.where(floor == self.base[text], floor, self.first[k]))
        return np.where(self.breaks[k], own, self.first[k]) - self.base[text]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Texts become Python strings one cut at a time."""
    for batch in batches:
        a, held = 0, 0
        for i, n in enumerate(pc.utf8_length(batch.column("text")).to_pylist()):
            if held and held + n > CHUNK:
                yield (part := batch.slice(a, i - a)), part.column("text").to_pylist()
                a, held = i, 0
            held += n + 1
        if a < batch.num_rows:
            yield (part := batch.slice(a)), part.column("text").to_pylist()


def _runs(least_words: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            cut = Cut(texts, least_words, window)
            which = cut.text[cut.at[cut.start]]
            rows = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(rows), batch.column("row").take(rows),
                 pa.array((np.arange(len(which)) - cut.runs_upto[which]).astype(np.int32)),
                 pa.array(cut.hashes[0]), pa.array(cut.hashes[1])], names=["d", "row", "i", "h", "h2"])
    return run


def _remove(least_words: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches):
            cut = Cut(texts, least_words, window)
            places = cut.places()
            of_piece = cut.text[cut.at[:-1]]
            first_piece = np.searchsorted(of_piece, np.arange(len(texts) + 1))
            out = []
            for n, (text, gone) in enumerate(zip(texts, batch.column("gone").to_pylist())):
                a, b, base = first_piece[n], first_piece[n + 1], cut.base[n]
                stop = base + len(text)
                n_sentences = int(cut.over[stop] - cut.over[base]) + (len(text) > 0 and text[-1] not in _TERMINATORS)
                if not gone:
                    out.append((n_sentences, 0, 0, text))
                    continue
                dead = np.zeros(b - a + 1, np.int8)
                for r in gone:
                    dead[cut.start[cut.runs_upto[n] + r] - a:cut.stop[cut.runs_upto[n] + r] - a] = 1
                edge = np.flatnonzero(np.diff(dead, prepend=0))
                at = np.append(places[a:b], len(text))
                kept, done, lost = [], 0, set()
                for x, y in zip(edge[::2], edge[1::2]):
                    kept.append(text[done:at[x]])
                    done = at[y]
                    words = cut.first[cut.at[a + x]:cut.at[a + y]]
                    lost.update(np.unique(cut.over[words]).tolist())
                out.append((n_sentences, len(lost), len(edge) // 2, "".join(kept) + text[done:]))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("id")] + [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])],
                names=["id", "n_sentences", "n_removed", "n_spans", "kept_text"])
    return run


def dedup_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
                    window: int = WINDOW) -> DataFrame:
    """One row per input row: id, n_sentences, n_removed (sentences that went or lost a piece), n_spans (separate
    removed stretches), kept_text."""
    d = docs.select(F.col(id_col).alias("id"), ordered_id(id_col).alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("row", F.xxhash64("text"))
    runs = d.select("d", "row", "text").mapInArrow(_runs(least_words, window), "d long, row long, i int, h long, h2 long")
    twice = store(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-hashes")
    found = store(runs.join(twice, "h"), "repeated-runs")
    place = F.struct("d", "i")
    firsts = found.groupBy("h", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "h2", "first")
    gone = (found.join(firsts, ["h", "h2"]).where(place > F.col("first"))
            .groupBy("d", "row").agg(F.collect_set("i").alias("gone")))
    kind = dict(d.dtypes)["id"]
    return (d.join(gone, ["d", "row"], "left").select("id", "text", "gone")
            .mapInArrow(_remove(least_words, window), f"id {kind}, n_sentences long, n_removed long, n_spans long, kept_text string")
            .withColumnRenamed("id", id_col))
