"""Shards against a plain search over all capacities."""

import random
import zlib
from collections import Counter

import pytest

from fieldlab.llm.sharding import shard_documents, smallest_capacity

LAST = 2 ** 63 - 1


def plain_capacity(sizes, shards):
    def fits(c):
        used, room = 0, 0
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards
    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("cells", [4, 50, 10 ** 5])
@pytest.mark.parametrize("shards,n", [(1, 30), (3, 200), (7, 1500)])
def test_smallest_capacity(spark, cells, shards, n, monkeypatch):
    from fieldlab.llm import sharding
    pick = random.Random(n)
    sizes = [pick.choice([1, 16, pick.randrange(1, 400), pick.randrange(1, 4000)]) for _ in range(n)]
    upto, at = [], 0
    for s in sizes:
        at += s
        upto.append(at)
    df = spark.createDataFrame([(x,) for x in upto], "upto long").cache()
    reads = []
    plain = sharding._read
    monkeypatch.setattr(sharding, "_read", lambda *a: reads.append(plain(*a)) or reads[-1])
    capacity, ends = smallest_capacity(df, at, shards, cells)
    assert capacity == plain_capacity(sizes, shards)
    assert ends[-1] == at and all(b - a <= capacity for a, b in zip([0] + ends, ends)) and set(ends) <= set(upto)
    assert all(len(r) <= 2 * max(cells, 16 * shards ** 2) + shards for r in reads)


@pytest.mark.parametrize("slice_rows", [4096, 60])
def test_shards(spark, slice_rows):
    pick = random.Random(2)
    rows = [(i, "é" * pick.randrange(300)) for i in range(400)] + [(1000 + i, "copy " * 20) for i in range(300)]
    rows += [(2000, None), (2001, ""), (None, "nobody"), (None, "nobody"), (5, "again"), (5, "again"), (2002, "w " * 200_000)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, size int, key string").repartition(4)
    got = shard_documents(df, shards=8, slice_rows=slice_rows).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len(text(t)) + 16, zlib.crc32(text(t))) for d, t in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    homes = {}
    for r in got:
        homes.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    sizes, first = Counter(), {}
    for d, t in rows:
        sizes[text(t)] += len(text(t)) + 16
        first[text(t)] = min(first.get(text(t), LAST), LAST if d is None else d)
    left, n, total = sorted(sizes, key=lambda t: -sizes[t]), 8, sum(sizes.values())
    while left and sizes[left[0]] * n >= total:
        total, n = total - sizes[left.pop(0)], n - 1
    filled = Counter()
    for r in got:
        filled[r.shard] += r.size
    assert max(filled[s] for s in range(8 - n, 8)) == plain_capacity([sizes[t] for t in sorted(left, key=lambda t: (first[t], t))], n)
    assert min(filled[s] for s in range(8 - n, 8)) > 0.9 * max(filled[s] for s in range(8 - n, 8))


def test_few_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot) for r in shard_documents(df).collect()}
    assert got[1][0] == got[3][0] != got[2][0]
    assert shard_documents(df.limit(0)).count() == 0
