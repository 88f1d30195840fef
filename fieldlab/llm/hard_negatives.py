"""Hard negatives of anchor vectors by vertical scans over columnar blocks (BOND).

Vectors are quantised to integers and kept in blocks: the values of one dimension
lie together, with the least and greatest value of each. For an anchor, a block's
dimensions are read in falling order of the anchor's magnitude; what the dimensions
not yet read can still add to a score, at least and at most, bounds every
candidate, and candidates whose bounds leave every open result lose their bit.
Those left when all dimensions are read, or when few are left, are scored exactly.

Two scans are made. The first finds each anchor's positives, its best rows of the
same label. Their scores open a window each, and the second scan finds the best
rows of other labels inside every window. A block's best rows are merged over all
blocks. Anchors are a stated query set; slices of ``SLICE_BYTES`` of them are
broadcast one after the other, and each slice is met by every block.

Rows with a null label, a null vector, or a null or non-finite component take no
part. A vector shorter than others counts zeros for what it lacks. An anchor's
positives have another id; rows that share an id are rows of their own, and
a null id comes last among ties and is no anchor. Quantised components and scores
that do not fit a long are cut to its ends. An empty table gives no rows. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, store

POSITIVES = 5
NEGATIVES = 5
LOW, HIGH, OF = 80, 100, 100
SCALE = 256
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 32 << 20
STEP = 8
_BIG = 2 ** 62

_BLOCK = "ids array<long>, labels array<long>, dims int, wide boolean, columns binary, least array<double>, greatest array<double>"
_ANCHORS = "g long, ids array<long>, labels array<long>, dims int, columns binary"


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and a matrix (rows x dimensions, zeros at the end of shorter ones) of whole numbers, as doubles."""
    vectors = batch.column("v")
    ends = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    sizes = np.diff(ends)
    dims = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return batch.column("id").to_numpy(), batch.column("label").to_numpy(), out


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    dims = max(m.shape[1] for _, _, m in parts)
    return (np.concatenate([i for i, _, _ in parts]), np.concatenate([x for _, x, _ in parts]),
            np.concatenate([np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for _, _, m in parts]))


def _blocks(block_bytes: int):
    """Rows -> columnar blocks of bounded size."""
    def emit(parts):
        ids, labels, m = _merged(parts)
        wide = bool(np.abs(m).max(initial=0) >= 2 ** 31)
        columns = m.T.astype(np.float64 if wide else np.int32)
        return pa.RecordBatch.from_pylist([{
            "ids": ids.tolist(), "labels": labels.tolist(), "dims": m.shape[1], "wide": wide, "columns": columns.tobytes(),
            "least": m.min(axis=0).tolist(), "greatest": m.max(axis=0).tolist()}], schema=pa.schema([
                ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("dims", pa.int32()), ("wide", pa.bool_()),
                ("columns", pa.binary()), ("least", pa.list_(pa.float64())), ("greatest", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            room = max(1, block_bytes // max(1, 4 * max([1, *np.diff(batch.column("v").offsets.to_numpy())])))
            for a in range(0, batch.num_rows, room):
                part = _rows(batch.slice(a, room))
                held.append(part)
                size += 4 * part[2].size
                if size >= block_bytes:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)
    return run


def _clipped(x: np.ndarray) -> np.ndarray:
    return x if x.dtype != object else np.array([max(-2 ** 63, min(2 ** 63 - 1, v)) for v in x], object)


class _Scan:
    """One block against one anchor: partial scores of the candidates left, and what is still to come."""

    def __init__(self, columns: np.ndarray, least: np.ndarray, greatest: np.ndarray, anchor: np.ndarray, alive: np.ndarray):
        dims = min(len(columns), len(anchor))
        a = anchor[:dims]
        self.order = np.argsort(-np.abs(a), kind="stable")
        self.order = self.order[a[self.order] != 0]  # zeros add nothing
        self.a, self.columns, self.alive = a, columns, np.flatnonzero(alive)
        low, high = a * least[:dims], a * greatest[:dims]
        # what the dimensions after the first k add, at least and at most
        self.least = np.concatenate([np.cumsum(np.minimum(low, high)[self.order][::-1])[::-1], [0]])
        self.greatest = np.concatenate([np.cumsum(np.maximum(low, high)[self.order][::-1])[::-1], [0]])
        self.scores, self.read = np.zeros(len(self.alive), columns.dtype if columns.dtype == object else np.int64), 0

    def step(self) -> bool:
        """Read some more dimensions; False when all are read."""
        if self.read >= len(self.order) or not len(self.alive):
            self.scores = _clipped(self.scores)
            return False
        for d in self.order[self.read:self.read + STEP]:
            self.scores = self.scores + self.columns[d][self.alive] * self.a[d]
        self.read = min(self.read + STEP, len(self.order))
        return True

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return _clipped(self.scores + self.least[self.read]), _clipped(self.scores + self.greatest[self.read])

    def keep(self, bits: np.ndarray) -> None:
        self.alive, self.scores = self.alive[bits], self.scores[bits]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        enough = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(enough)
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def best_of_block(scan: _Scan, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(row, score) of the block's k best."""
    while scan.step():
        if len(scan.alive) > k:
            low, high = scan.bounds()
            scan.keep(high >= (np.sort(low)[-k] if low.dtype == object else np.partition(low, len(low) - k)[len(low) - k]))
    return [(int(scan.alive[i]), scan.scores[i]) for i in _best(scan.scores, ids[scan.alive], k)]


def windows_of_block(scan: _Scan, ids: np.ndarray, windows: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """(window, row, score): of each window (name, least, greatest score) the block's k best."""
    while scan.step():
        low, high = scan.bounds()
        bits = np.zeros(len(scan.alive), bool)
        for _, a, b in windows:
            inside = np.sort(low[(low >= a) & (high <= b)])
            a = inside[-k] if len(inside) >= k else a  # so many are sure to be inside with that score or more
            bits |= (high >= a) & (low <= b)
        scan.keep(bits)
    out = []
    for w, a, b in windows:
        at = np.flatnonzero((scan.scores >= a) & (scan.scores <= b))
        out += [(w, int(scan.alive[at[i]]), scan.scores[at[i]]) for i in _best(scan.scores[at], ids[scan.alive[at]], k)]
    return out


def _meet(work):
    """Pairs of a block and a group of anchors -> what ``work`` finds for each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                n, dims = len(row["ids"]), row["dims"]
                columns = np.frombuffer(row["columns"], np.float64 if row["wide"] else np.int32).reshape(dims, n)
                anchors = np.frombuffer(row["a_columns"], np.float64).reshape(len(row["a_ids"]), row["a_dims"])
                least, greatest = np.array(row["least"]), np.array(row["greatest"])
                most = np.maximum(np.abs(least), np.abs(greatest)).max(initial=0) * np.abs(anchors).max(initial=0) * max(1, dims)
                if most >= _BIG:  # beyond 64 bits: whole numbers of any size
                    whole = lambda m: np.array([int(x) for x in m.ravel()], object).reshape(m.shape)
                    columns, anchors, least, greatest = whole(columns), whole(anchors), whole(least), whole(greatest)
                else:
                    columns, anchors = columns.astype(np.int64), anchors.astype(np.int64)
                    least, greatest = least.astype(np.int64), greatest.astype(np.int64)
                ids, labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
                found = [(row["g"], j, *f) for j in range(len(anchors))
                         for f in work(row, j, ids, labels, lambda alive: _Scan(columns, least, greatest, anchors[j], alive))]
                names = ["g", "j", "w", "id", "score"]
                cells = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=names)
    return run


def _positives(k: int):
    def work(row, j, ids, labels, scan):
        alive = (labels == row["a_labels"][j]) & (ids != row["a_ids"][j])
        return [(0, int(ids[r]), int(s)) for r, s in best_of_block(scan(alive), ids, k)]
    return work


def _negatives(k: int, low: int, high: int, of: int):
    def work(row, j, ids, labels, scan):
        windows = [(p["rank"], -(-low * p["score"] // of), high * p["score"] // of) for p in row["found"] or [] if p["j"] == j]
        windows = [w for w in windows if w[1] <= w[2]]
        if not windows:
            return []
        return [(w, int(ids[r]), int(s)) for w, r, s in windows_of_block(scan(labels != row["a_labels"][j]), ids, windows, k)]
    return work


def _anchor_groups(per_group: int):
    """Anchor rows -> groups of bounded size; doubles hold the whole numbers exactly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, per_group):
                ids, labels, m = _rows(batch.slice(a, per_group))
                yield pa.RecordBatch.from_pylist(
                    [{"ids": ids.tolist(), "labels": labels.tolist(), "dims": m.shape[1], "columns": m.tobytes()}],
                    schema=pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("dims", pa.int32()), ("columns", pa.binary())]))
    return run


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, of: int = OF, scale: int = SCALE, block_bytes: int = BLOCK_BYTES,
                   slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on the columns of ``vectors``. A negative's score lies
    between ``low`` and ``high`` parts of ``of`` of its positive's score.
    """
    spark = vectors.sparkSession
    component = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = (vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
            .select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.col(label_col).cast("long").alias("label"),
                    component.alias("v"), (anchor & F.col(id_col).isNotNull()).alias("is_anchor")))
    rows = rows.where("size(v) > 0")
    blocks = store(rows.select("id", "label", "v").mapInArrow(_blocks(block_bytes), _BLOCK), "vector-blocks")
    asked = rows.where("is_anchor").select("id", "label", "v")
    dims = max(1, blocks.agg(F.max("dims")).first()[0] or 1)
    per_group = max(1, min(1024, slice_bytes // (16 * dims)))
    groups = store(asked.mapInArrow(_anchor_groups(per_group), "ids array<long>, labels array<long>, dims int, columns binary")
                   .select(F.monotonically_increasing_id().alias("g"), "*"), "anchor-groups")
    # Slices of bounded bytes along the groups' numbers; the driver sees one number and one size a group.
    slices, held = [], slice_bytes
    for g, size in sorted(groups.select("g", F.length("columns") + 16 * F.size("ids")).collect()):
        if held + size > slice_bytes:
            slices.append([])
            held = 0
        slices[-1].append(g)
        held += size

    def scan(asking: DataFrame, work, *more: str) -> DataFrame:
        out = None
        for some in slices:
            mine = asking.where(F.col("g").between(some[0], some[-1])).select(
                "g", *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "dims", "columns")], *more)
            # An equality on the group: every block meets each group of the slice once.
            met = blocks.withColumn("g", F.explode(F.array(*map(F.lit, some)))).join(F.broadcast(mine), "g")
            part = store(met.mapInArrow(_meet(work), "g long, j long, w long, id long, score long"), "found")
            out = part if out is None else out.union(part)
        return out if out is not None else spark.createDataFrame([], "g long, j long, w long, id long, score long")

    best = store(_top(scan(groups, _positives(positives)), ["g", "j"], positives).select("g", "j", "id", "score", "rank"), "positives")
    opened = best.groupBy("g").agg(F.collect_list(F.struct("j", "rank", "score")).alias("found"))  # at most positives x per_group
    asking = store(groups.join(opened, "g"), "anchor-groups")
    ends = _top(scan(asking, _negatives(negatives, low, high, of), "found"), ["g", "j", "w"], negatives)
    anchors = groups.select("g", F.posexplode("ids").alias("j", "anchor_id"))
    known = F.when(F.col("id") != LAST_ID, F.col("id"))
    return (ends.select("g", "j", "w", F.col("rank"), known.alias("negative_id"), F.col("score").alias("negative_score"))
            .join(best.select("g", "j", F.col("rank").alias("w"), known.alias("positive_id"), F.col("score").alias("positive_score")), ["g", "j", "w"])
            .join(anchors, ["g", "j"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
