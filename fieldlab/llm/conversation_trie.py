"""Prefix trie of conversations with subtree totals by parallel tree contraction.

A turn is known by the hash of its role and text. A prefix is known by its length
and by sums of hashes of (position, turn), so prefixes of a conversation of any
length are running sums, scanned in slices (``numbered``). Equal prefixes are one
node; its parent is the prefix without the last turn.

Totals over subtrees come from rounds of joins that contract the tree. Rake: every
leaf hands its total to its parent and is settled. Compress: of the nodes with one
child, those that come before parent and child in a random order of the round are
spliced out; such a node hands its sum to its parent, the child moves up to that
parent, and what stays is the debt "my total is my sum plus my child's total". A
leaf's child-less siblings go in one round and a chain loses about a third of its
nodes in each, so the rounds grow with the logarithm of the nodes, not with the
depth. When nothing is left the debts are paid back by pointer doubling: expanded,
every contracted node has its total.

Rows with a null conversation take no part. A null turn comes first; turns that tie
are ordered by the hash of role and text, so repeated rows are turns of their own.
Null roles and texts are empty. Long texts count as any other, only their hash and
size travel. An empty table has no nodes. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ROWS_PER_TASK, numbered
from .common import few, store

OPENING = 9
FAMILY = 5
CHUNK = 1 << 16
SUMS = ("s1", "s2", "s3", "s4")


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(conv, n, what, bytes): the turns of each conversation numbered from 1, known by a hash."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    known = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("what"), F.octet_length(text).cast("long").alias("bytes"))
    return store(numbered(store(known, "turns"), ["conv"], ["turn", "what"], rows_per_task=rows_per_task)
                 .select("conv", F.col("n").alias("n"), "what", "bytes"), "turns")


def shared_openings(turns: DataFrame, family: int = FAMILY, opening: int = OPENING) -> tuple[DataFrame, DataFrame]:
    """Numbered turns -> those of conversations that start with turns of their family's first, and all conversations.

    A conversation c takes the first h turns of c - c % family, h = crc32(c) % opening,
    and then its own after its first h.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % opening
    sizes = turns.groupBy("conv").agg(F.count("*").alias("size"))
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % family).alias("base"), h.alias("h"))
    convs = store(convs.join(sizes.select(F.col("conv").alias("base"), "size"), "base", "left")
                  .select("conv", "base", "h", F.least("h", F.coalesce("size", F.lit(0))).alias("lent")), "conversations")
    heads = turns.where(F.col("n") < opening).withColumnRenamed("conv", "base")
    lent = convs.select("base", "conv", "h").join(heads, "base").where("n <= h").select("conv", "n", "what", "bytes")
    own = (turns.where(F.col("n") > h).join(few(convs.select("conv", "h", "lent")), "conv")
           .select("conv", (F.col("n") - F.col("h") + F.col("lent")).alias("n"), "what", "bytes"))
    return store(lent.union(own), "rebuilt"), convs.select("conv")


def _prefix(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums)))


def prefixes(turns: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Numbered turns -> (conv, depth, node, parent, bytes, ends) of each prefix with a turn."""
    a, b = F.xxhash64("n", "what"), F.xxhash64(F.lit("second"), "n", "what")
    terms = {f"t{i}": x for i, x in enumerate((F.shiftrightunsigned(a, 32), a.bitwiseAND(0xFFFFFFFF),
                                               F.shiftrightunsigned(b, 32), b.bitwiseAND(0xFFFFFFFF)), 1)}
    summed = numbered(turns.withColumns(terms), ["conv"], ["n"], name="depth", total="size",
                      running=dict(zip(SUMS, terms)), rows_per_task=rows_per_task)
    upto, before = [F.col(s) for s in SUMS], [F.col(s) - F.col(t) for s, t in zip(SUMS, terms)]
    return summed.select("conv", "depth", _prefix(F.col("depth"), upto).alias("node"),
                         _prefix(F.col("depth") - 1, before).alias("parent"), "bytes", (F.col("depth") == F.col("size")).alias("ends"))


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(node, parent, values) of a forest, values long -> (node, values summed over the subtree)."""
    left = store(nodes.select(F.col("node").alias("v"), F.col("parent").alias("p"), *values), "tree")
    done, turn = [], 0
    while not left.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: E731, B023
        kids = left.where("p IS NOT NULL").groupBy(F.col("p").alias("v")).agg(F.count("*").alias("k"), F.min("v").alias("c"))
        splice = F.col("p").isNotNull() & (F.col("k") == 1) & (rank("v") < rank("c")) & (rank("v") < rank("p"))
        seen = store(left.join(kids, "v", "left").withColumn(
            "kind", F.when(F.col("k").isNull(), "leaf").when(splice, "spliced").otherwise("stays")), "round")
        spliced = seen.where("kind = 'spliced'")
        up = spliced.select(F.col("c").alias("v"), F.col("p").alias("over"))
        moved = (seen.where("kind <> 'spliced'").join(up, "v", "left")
                 .withColumn("p", F.coalesce("over", "p")).select("v", "p", "kind", *values))
        handed = (moved.where("kind = 'leaf' AND p IS NOT NULL").select("p", *values).union(spliced.select("p", *values))
                  .groupBy(F.col("p").alias("v")).agg(*[F.sum(x).alias(f"more_{x}") for x in values]))
        left = store(moved.where("kind = 'stays'").join(handed, "v", "left").select(
            "v", "p", *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in values]), "tree")
        done.append(seen.where("kind <> 'stays'").select("v", F.when(F.col("kind") == "spliced", F.col("c")).alias("debt"), *values))
    if not done:
        return nodes.select("node", *values)
    known = done[0]
    for part in done[1:]:
        known = known.union(part)
    known = store(known, "contracted")
    while not known.where("debt IS NOT NULL").isEmpty():
        to = known.select(F.col("v").alias("debt"), F.col("debt").alias("next"), *[F.col(x).alias(f"more_{x}") for x in values])
        paid = known.where("debt IS NOT NULL").join(to, "debt").select(
            "v", F.col("next").alias("debt"), *[(F.col(x) + F.col(f"more_{x}")).alias(x) for x in values])
        known = store(known.where("debt IS NULL").union(paid), "contracted")
    return known.select(F.col("v").alias("node"), *values)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order -> comma-joined strings of bounded size: (node, first, ids)."""
    node, first, ids, size = None, None, [], 0
    for batch in batches:
        out = []
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()):
            if ids and (n != node or size >= CHUNK):
                out.append((node, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield _chunk_batch(out)
    if ids:
        yield _chunk_batch([(node, first, ",".join(ids))])


def _chunk_batch(rows: list) -> pa.RecordBatch:
    cells = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings in order -> SHA-256 of each node's, joined; one string is held at a time."""
    node, state = None, None
    for batch in batches:
        out = []
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if n != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _hash_batch(out)
    if state is not None:
        yield _hash_batch([(node, state.hexdigest())])


def _hash_batch(rows: list) -> pa.RecordBatch:
    cells = list(zip(*rows)) if rows else [[]] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.binary(), pa.string()))], names=["node", "ends_sha256"])


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(node, conv) -> hash of each node's ids. SHA-256 has an order, so a hot node's ids
    are sorted and joined in many tasks, and only their joined strings meet in one."""
    joined = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(
        _chunks, "node binary, first long, ids string")
    return (joined.select("node", "first", "ids").repartition("node").sortWithinPartitions("node", "first")
            .mapInArrow(_hashed, "node binary, ends_sha256 string"))


def conversation_trie(turns: DataFrame, convs: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Numbered turns (and ids of conversations, some perhaps without turns) -> one row per node.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the node's and its parent's key.
    """
    rows = store(prefixes(turns, rows_per_task), "prefixes")
    convs = rows.select("conv").distinct() if convs is None else convs
    top = _prefix(F.lit(0), [F.lit(0)] * len(SUMS))
    root = (convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
            .select(top.alias("node"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"),
                    "n_convs", F.lit(0).cast("long").alias("bytes")))
    nodes = rows.groupBy("node").agg(F.min("parent").alias("parent"), F.min("conv").alias("conv_id"), F.min("depth").alias("depth"),
                                     F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    nodes = store(nodes.unionByName(root), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = store(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    totals = subtree_totals(nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                                         ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    turnless = convs.join(rows.where("depth = 1").select("conv"), "conv", "left_anti").select(top.alias("node"), "conv")
    ends = _end_hashes(rows.where("ends").select("node", "conv").union(turnless))
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(totals, "node").join(ends, "node", "left").join(named, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "node", "parent"))
