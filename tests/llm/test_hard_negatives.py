"""Hard negatives against all pairs, with odd rows, in blocks of a few rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldlab.llm.hard_negatives import hard_negatives

LAST = 2 ** 63 - 1


def brute(rows, is_anchor, positives=5, negatives=5, low=80, of=100):
    rows = [(LAST if i is None else i, x, [math.floor(256 * c) for c in v]) for i, v, x in rows
            if x is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    name = lambda i: None if i == LAST else i
    out = []
    for i, x, v in rows:
        if i == LAST or not is_anchor(i):
            continue
        scored = sorted((-max(-2 ** 63, min(LAST, sum(a * b for a, b in zip(v, w)))), j, y) for j, y, w in rows if j != i or y != x)
        for ps, p in [(-s, j) for s, j, y in scored if y == x][:positives]:
            found = [(-s, j) for s, j, y in scored if y != x and low * ps <= of * -s <= of * ps][:negatives]
            out += [(i, name(p), n + 1, name(j), ps, s) for n, (s, j) in enumerate(found)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes,slice_bytes", [(4 << 20, 32 << 20), (800, 900)])
def test_all_pairs(spark, block_bytes, slice_bytes):
    pick = random.Random(3)
    rows = [(i, [pick.gauss(0.1, 0.3) for _ in range(12)], pick.randrange(4)) for i in range(240)]
    same = [0.25] * 12
    rows += [(1000 + i, same, i % 3) for i in range(60)]  # ties everywhere
    rows += [(2000, None, 1), (2001, [0.1, None], 1), (2002, [float("nan")] * 12, 1), (2003, [float("inf")] + [0.0] * 11, 1),
             (2004, same, None), (2005, [], 1), (2010, [1.5, 2.5], 2), (2020, [0.0] * 12, 0), (None, same, 1), (None, [0.5] * 12, 2),
             (1000, same, 0), (1000, [0.3] * 12, 1), (2030, [-0.3] * 12, 3), (-10, [0.2] * 12, 3)]
    df = spark.createDataFrame([(i, v, x, "clash") for i, v, x in rows], "vec_id long, embedding array<double>, label int, id string").repartition(3)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, block_bytes=block_bytes, slice_bytes=slice_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, lambda i: i % 10 == 0)


def test_scores_beyond_a_long(spark):
    rows = [(i, [2.0 ** 30 * (1 + i % 5), -3.0 * i, 1e6], i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, lambda i: i % 10 == 0)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
