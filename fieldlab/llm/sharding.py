"""Documents into shards of near equal bytes by a minimax contiguous partition.

Rows with equal texts are one group and stay together; a group's size is the sum of
its rows' sizes (bytes of the text plus ``OVERHEAD`` each). A group of at least an
even share of what is left for the shards that are left gets a shard of its own,
greatest first, since no other placing makes that shard smaller. The others are put
in the order of their smallest id and cut where a greedy filling of the smallest
feasible capacity cuts: the capacity is found by binary search, each step checked
greedily over running sizes.

The running sizes stay distributed. The driver sees them as cells: the least,
greatest and number of the running sizes in an even stretch, at most ``cells``
of them. A greedy check with the known points alone is a valid filling; one that may
also cut anywhere inside a cell can't be beaten. Between the two lies the true
capacity, and only the stretches where the two fill differently are read again with
finer cells, until both agree, which is exact.

A null text counts as empty; a null id counts as the largest. Repeated rows are rows
of their own. An empty table gives no rows. There may be empty shards if there are
fewer groups than shards. Only the two named columns are read. All work on rows is
done by built-in functions.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .common import few, ordered_id, store

SHARDS = 40
OVERHEAD = 16
CELLS = 16_384
SLICE_ROWS = 4096
SLICES = 20_000  # at most so many slices, whatever the rows


class Cells:
    """What the driver knows of the running sizes: disjoint stretches with their end points, in order."""

    def __init__(self, cells: list[tuple[int, int, int]]):
        self.cells = sorted(cells)
        self.lows = [c[0] for c in self.cells]

    def upto(self, x: int, anywhere: bool) -> int:
        """The greatest running size of x or less; inside an open cell its start, or x itself if cuts may be ``anywhere``."""
        i = bisect_right(self.lows, x) - 1
        if i < 0:
            return 0
        low, high, n = self.cells[i]
        return high if x >= high else x if anywhere and n > 2 else low

    def fill(self, capacity: int, shards: int, anywhere: bool) -> list[int]:
        """Ends of greedily filled shards."""
        ends = [0]
        for _ in range(shards):
            ends.append(self.upto(ends[-1] + capacity, anywhere))
        return ends[1:]

    def least(self, total: int, shards: int, anywhere: bool) -> int:
        """Smallest capacity whose greedy filling takes everything, by binary search."""
        low, high = -(-total // shards), total
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, shards, anywhere)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, low: list[int], high: list[int]) -> list[tuple[int, int]]:
        """One stretch for each end of a shard that is not yet known, from the first open cell that may hold it to the last; overlaps are merged."""
        out: list[list[int]] = []
        for a, b in sorted(zip(low, high)):
            within = range(max(0, bisect_right(self.lows, a) - 1), bisect_right(self.lows, b))
            opened = [i for i in within if self.cells[i][2] > 2 and self.cells[i][1] >= a]
            if opened and out and self.cells[opened[0]][0] <= out[-1][1]:
                out[-1][1] = max(out[-1][1], self.cells[opened[-1]][1])
            elif opened:
                out.append([self.cells[opened[0]][0], self.cells[opened[-1]][1]])
        return [(a, b) for a, b in out]

    def replaced(self, stretches: list[tuple[int, int]], finer: list[tuple[int, int, int]]) -> Cells:
        stops = [b for _, b in stretches]

        def inside(cell):
            i = bisect_left(stops, cell[1])
            return i < len(stretches) and stretches[i][0] <= cell[0]
        return Cells([c for c in self.cells if not inside(c)] + finer)


def _read(running: DataFrame, stretches: list[tuple[int, int]], cells: int) -> list[tuple[int, int, int]]:
    """Least, greatest and number of the running sizes (column upto) of each part of the stretches."""
    width = max(1, -(-sum(b - a + 1 for a, b in stretches) // cells))
    which, wanted = F.lit(0), F.lit(False)
    for a, b in stretches:
        which, wanted = which + (F.col("upto") > b).cast("int"), wanted | F.col("upto").between(a, b)
    found = running.where(wanted).groupBy(which.alias("stretch"), F.floor(F.col("upto") / width).alias("part")).agg(
        F.min("upto"), F.max("upto"), F.count("*"))
    return [tuple(r)[2:] for r in found.collect()]


def smallest_capacity(running: DataFrame, total: int, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """Running sizes (column ``upto``, up to ``total``) -> smallest feasible capacity and the ends of the shards.

    The driver holds at most ``cells`` cells a reading (or 16 for each pair of shards).
    """
    cells = max(cells, 16 * shards * shards)
    known = Cells(_read(running, [(1, total)], cells))
    while True:
        low, high = known.least(total, shards, True), known.least(total, shards, False)
        stretches = known.unsure(known.fill(low, shards, False), known.fill(high, shards, True))
        if not stretches:
            return high, known.fill(high, shards, False)
        known = known.replaced(stretches, _read(running, stretches, cells))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                    cells: int = CELLS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per input row: id, size, text_crc32, law (``bytes``), shard, slot (in the order of the groups, then of ids)
    and grown_shard (null under this law)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = store(docs.select(F.col(id_col).alias("id"), ordered_id(id_col).alias("d"),
                             (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                             F.unhex(F.md5(text)).alias("key")), "sizes")
    groups = store(rows.groupBy("key").agg(F.min("d").alias("first"), F.sum("size").alias("bytes")), "groups")
    total, n_groups = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    n_rows = rows.count()
    alone: list[bytes] = []
    for key, size in groups.orderBy(F.desc("bytes"), "first", "key").limit(shards).select("key", "bytes").collect():
        if not size * (shards - len(alone)) >= total:
            break
        alone.append(bytes(key))
        total -= size
    places = groups.where(F.col("key").isin(alone)).select(
        "key", "first", F.array_position(F.array(*map(F.lit, alone)), F.col("key")).cast("int").alias("shard")) if alone else None
    if places is not None:
        places = places.withColumn("shard", F.col("shard") - 1)
    if total:
        rest = groups.where(~F.col("key").isin(alone)) if alone else groups
        running = store(numbered(rest.withColumn("all", F.lit(0)), ["all"], ["first", "key"], running={"upto": "bytes"},
                                 rows_per_task=max(slice_rows, n_groups // SLICES)).select("key", "first", "upto"), "running-sizes")
        ends = smallest_capacity(running, total, shards - len(alone), cells)[1]
        before = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col("upto")))
        cut = running.select("key", "first", (before + len(alone)).alias("shard"))
        places = cut if places is None else places.union(cut)
    if places is None:
        places = groups.select("key", "first", F.lit(0).alias("shard"))
    placed = store(rows.join(few(store(places, "places")), "key"), "placed")
    slots = numbered(placed, ["shard"], ["first", "key", "d"], name="slot", rows_per_task=max(slice_rows, n_rows // SLICES))
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                        (F.col("slot") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
