"""Prefix trie against a plain tree, with deep chains, wide nodes and odd rows."""

import hashlib
import random
import zlib

import pytest

from fieldlab.llm.conversation_trie import conversation_trie, ordered_turns, shared_openings, subtree_totals


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            what = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, what, (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        rebuilt[c] = own.get(base, [])[:h] + t[h:]
    members, ends = {}, {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
        ends.setdefault(tuple(t), []).append(c)
    kids = {}
    for way in members:
        if way:
            kids.setdefault(way[:-1], []).append(way)
    leaves, saved = {}, {}
    for way in sorted(members, key=len, reverse=True):
        leaves[way] = sum(leaves[k] for k in kids.get(way, [])) if way in kids else 1
        saved[way] = sum(saved[k] for k in kids.get(way, [])) + ((len(members[way]) - 1) * len(way[-1][1].encode()) if way else 0)
    return sorted(((min(m), len(w), min(members[w[:-1]]) if w else None, len(m), len(kids.get(w, [])), leaves[w], saved[w],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(w, [])))).encode()).hexdigest()) for w, m in members.items()), key=repr)


def trie(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    found = conversation_trie(*shared_openings(ordered_turns(df.repartition(3), **options)), **options).drop("node", "parent")
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 40])
def test_trie(spark, rows_per_task):
    pick = random.Random(6)
    words = ["hello", "and then", "", "naïve ✓", "x" * 3000]
    rows = [(c, t, pick.choice(["user", "bot"]), pick.choice(words)) for c in range(60) for t in range(pick.randrange(1, 9))]
    rows += [(c, t, "user", f"step {t}") for c in (100, 101, 102, 107) for t in range(90)]  # long, alike
    rows += [(c, t, "user", "the same") for c in range(200, 260) for t in range(3)]
    rows += [(300, None, "user", "first"), (300, 1, None, None), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (None, 1, "user", "nobody"),
             (-7, 1, "user", "minus"), (-5, 2, "user", "minus five"), (404, 1, "user", "no head"), (2 ** 40 + 3, 1, "user", "far")]
    assert trie(spark, rows, rows_per_task=rows_per_task) == brute(rows)


def test_totals_of_any_forest(spark):
    pick = random.Random(8)
    parents = {f"n{i}".encode(): None if i % 40 == 0 else f"n{i - 1 if i % 3 else pick.randrange(i)}".encode() for i in range(240)}
    value = {v: pick.randrange(100) for v in parents}
    want = dict(value)
    for v in parents:
        p = parents[v]
        while p is not None:
            want[p] += value[v]
            p = parents[p]
    df = spark.createDataFrame([(v, p, value[v]) for v, p in parents.items()], "node binary, parent binary, x long")
    assert {bytes(r.node): r.x for r in subtree_totals(df, ["x"]).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_trie(*shared_openings(ordered_turns(df))).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], df.schema)
    assert conversation_trie(*shared_openings(ordered_turns(nobody))).count() == 0
