"""Ordered operators against plain windows, including a hot series."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlab.operators import aggregates as A
from fieldlab.operators import ordered as W
from fieldlab.operators import quantiles as Q
from fieldlab.operators import reshape


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.6 else None if rng.random() < 0.1 else f"k{rng.randrange(9)}",
             rng.randrange(0, 500), i, round(rng.gauss(0, 3), 2)) for i in range(3000)]
    return spark.createDataFrame(data, "k string, t int, id int, v double"), pd.DataFrame(data, columns=["k", "t", "id", "v"])


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 100])
def test_numbering_in_many_slices_equals_one_window(series, rows_per_task):
    df, p = series
    got = W.numbered(df, ["k"], ["t", "id"], total="n_all", running="v", ends="v", rows_per_task=rows_per_task).toPandas()
    assert len(got) == len(p)
    p = p.assign(k=p.k.fillna("NULL")).sort_values(["k", "t", "id"])
    g = p.groupby("k")
    want = p.assign(n=g.cumcount() + 1, n_all=g.id.transform("size"), running=g.v.cumsum(),
                    first_value=g.v.transform("first"), last_value=g.v.transform("last")).set_index("id").sort_index()
    got = got.set_index("id").sort_index()
    for c in ("n", "n_all", "first_value", "last_value"):
        assert (got[c] == want[c]).all(), c
    assert (got.running - want.running).abs().max() < 1e-9


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 200, 20])
def test_ranks_of_values_with_heavy_ties(spark, rows_per_task):
    rng = random.Random(8)
    data = [("g" if rng.random() < 0.7 else "h", rng.choice([1.0, 1.0, 2.5, -3.0, round(rng.gauss(0, 1e3), 1)]), i) for i in range(1500)]
    df = spark.createDataFrame(data, "k string, v double, id int")
    got = W.numbered(df, ["k"], ["v", "id"], total="m", rows_per_task=rows_per_task).toPandas().set_index("id").sort_index()
    p = pd.DataFrame(data, columns=["k", "v", "id"]).sort_values(["k", "v", "id"])
    want = p.assign(n=p.groupby("k").cumcount() + 1, m=p.groupby("k").id.transform("size")).set_index("id").sort_index()
    assert (got.n == want.n).all() and (got.m == want.m).all()


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 50])
def test_crowded_instant_with_a_text_tie(spark, rows_per_task):
    rng = random.Random(5)
    data = [("hot", None if rng.random() < 0.02 else 7 if rng.random() < 0.9 else rng.randrange(20), f"id-{i:04d}", i % 7)
            for i in range(2000)] + [("cold", 1, "z", 2), ("cold", 1, "a", 3)]
    df = spark.createDataFrame(data, "k string, t int, tie string, v long")
    got = W.numbered(df, ["k"], ["t", "tie"], total="m", running={"upto": "v"}, ends="tie", rows_per_task=rows_per_task).collect()
    want, n, upto = {}, {}, {}
    for k, t, tie, v in sorted(data, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
        n[k], upto[k] = n.get(k, 0) + 1, upto.get(k, 0) + v
        want[k, tie] = (n[k], upto[k])
    assert {(r.k, r.tie): (r.n, r.upto) for r in got} == want
    assert {(r.k, r.m) for r in got} == {("hot", 2000), ("cold", 2)}
    assert {r.first_value for r in got if r.k == "cold"} == {"a"} and {r.last_value for r in got if r.k == "cold"} == {"z"}


def test_no_slice_holds_a_crowd(spark):
    """Rows that are equal in key, order and tie are spread too."""
    df = spark.range(4000, numPartitions=4).select(F.lit("k").alias("k"), F.lit(3).alias("t"))
    hot = df.groupBy("k").agg(F.count("*").alias("hot_n"))
    sizes = [r["count"] for r in W._sliced(df, ["k"], ["t"], hot, 200).groupBy("slice").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 200
    numbers = sorted(r.n for r in W.numbered(df, ["k"], ["t"], rows_per_task=200).collect())
    assert numbers == list(range(1, 4001))


def test_skip_then_thin(series):
    df, p = series
    p = p.assign(k=p.k.fillna("NULL")).sort_values(["k", "t", "id"])
    n = p.groupby("k").cumcount() + 1
    assert {r.id for r in W.skip_first(df, ["k"], ["t", "id"], 5).collect()} == set(p.id[n > 5])
    assert {r.id for r in W.every_kth(df, ["k"], ["t", "id"], 7, rows_per_task=100).collect()} == set(p.id[n % 7 == 0])


def test_first_last_top_nth(spark, rows):
    df = spark.createDataFrame([("a", 2, 20.0), ("a", 1, 10.0), ("b", 1, 5.0)], "k string, t int, v double")
    assert rows(W.first_last(df, ["k"], ["t"], "v")) == [("a", 10.0, 20.0, 2), ("b", 5.0, 5.0, 1)]
    assert rows(W.nth_record(df, ["k"], [F.col("t")], "v", (1, 2))) == [("a", 10.0, 20.0), ("b", 5.0, None)]
    assert rows(W.top_k(df, ["k"], [F.desc("v")], 1).select("k", "t")) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_quantiles_are_exact_for_any_magnitude(series, scale):
    df, p = series
    q = Q.exact_quantiles(df.withColumn("v", F.col("v") * scale), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.75}).toPandas()
    assert len(q) == p.k.nunique() + 1
    for _, r in q.iterrows():
        v = p.v[p.k.isna() if r.k is None or r.k != r.k else p.k == r.k] * scale
        assert r.n == len(v)
        for name, prob in (("a", 0.1), ("b", 0.5), ("c", 0.75)):
            assert abs(r[name] - v.quantile(prob)) < 1e-9 * scale


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 60])
def test_quantiles_of_crowded_values(spark, rows_per_task):
    """Values that differ in their last digits only, ties, NaN, a NULL key and short keys; no bracket above the bound."""
    rng = random.Random(3)
    data = [("near", 1.0 + rng.randrange(10 ** 6) * 1e-12) for _ in range(3000)]
    data += [("ties", rng.choice([1.0, 1.0, 1.0, 2.0, 2.0 + 1e-9])) for _ in range(2000)]
    data += [(None, rng.gauss(0, 1e6)) for _ in range(500)] + [("short", 4.0), ("short", 2.0), ("one", 7.0), ("none", None)]
    data += [("nan", float("nan") if i % 3 else float(i)) for i in range(300)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    probs = {"low": 0.0, "a": 0.1, "b": 0.5, "c": 0.773, "high": 1.0}
    got = {r.k: r for r in Q.exact_quantiles(df, ["k"], "v", probs, rows_per_task=rows_per_task).collect()}
    assert set(got) == {"near", "ties", None, "short", "one", "nan"}
    for k, r in got.items():
        v = sorted((x for kk, x in data if kk == k and x is not None), key=lambda x: (x != x, x))
        assert r.n == len(v)
        for name, p in probs.items():
            lo = int((len(v) - 1) * p)
            hi = min(lo + ((len(v) - 1) * p > lo), len(v) - 1)
            want = v[lo] + (v[hi] - v[lo]) * ((len(v) - 1) * p - lo)
            assert (r[name] != r[name] and want != want) or abs(r[name] - want) <= 1e-15 * max(1, abs(want)), (k, name)
    if rows_per_task == 60:
        x = df.filter("k = 'near'").select("k", "v")
        start = spark.createDataFrame([("near", "b", 3000, 1499, None, None, 0, 3000)],
                                      "k string, name string, n long, pos long, low double, high double, below long, inside long")
        b = Q.narrowed(x, ["k"], start, 60).first()
        assert b.inside <= 60 and b.below <= 1499 and b.below + b.inside > 1499


def test_box_summary_whiskers(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 30]], "g string, v double")
    b = Q.box_summary(df, ["g"], "v").first()
    assert (b.q1, b.q2, b.q3, b.whisker_low, b.whisker_high, b.outliers) == (3.0, 5.0, 7.0, 1.0, 8.0, 1)


def test_strict_and_skipping_aggregates(spark, rows):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "k string, v double")
    s = df.groupBy("k").agg(A.strict(F.avg, "v").alias("strict"), F.avg("v").alias("skip"))
    assert rows(s) == [("a", None, 1.0), ("b", 3.0, 3.0)]
    assert rows(A.mean_se(df, ["k"], "v"))[1][1:] == pytest.approx((3.0, 2 ** 0.5, 1.0))


def test_share_keeps_the_whole_as_denominator(spark, rows):
    df = spark.createDataFrame([("h", "x", 3.0), ("h", "y", 1.0), ("h", "x", 4.0)], "g string, i string, n double")
    assert rows(A.share_of_total(df, ["g"], "i", "n").select("i", "cover")) == [("x", 87.5), ("y", 12.5)]


def test_level_difference_and_lone_keys(spark, rows):
    df = spark.createDataFrame([("m", "LOW", 6.0), ("m", "HIGH", 4.0), ("z", "LOW", 1.0)], "m string, l string, v double")
    assert rows(A.level_difference(df, ["m"], "l", "v", "LOW", "HIGH")) == [("m", 6.0, 4.0, 50.0), ("z", 1.0, None, None)]
    assert rows(A.sole_or_repeated(df, ["m"])) == [("z", 1)]
    assert rows(A.sole_or_repeated(df, ["m"], repeated=True)) == [("m", 2)]


def test_widen_lengthen_round_trip(spark, rows):
    df = spark.createDataFrame([(1, "pre", 2.0), (1, "post", 3.0), (2, "pre", 5.0)], "id int, phase string, v double")
    wide = reshape.widen(df, ["id"], "phase", ["pre", "post"], "v")
    assert rows(wide) == [(1, 2.0, 3.0), (2, 5.0, None)]
    back = reshape.lengthen(wide, ["id"], ["pre", "post"], "phase", "v").dropna()
    assert rows(back) == rows(df)


def test_two_values_in_a_cell_stop_the_query(spark):
    df = spark.createDataFrame([(1, "pre", 2.0), (1, "pre", 3.0)], "id int, phase string, v double")
    with pytest.raises(Exception, match="more than one value"):
        reshape.widen(df, ["id"], "phase", ["pre"], "v").collect()


def test_skip_none(spark):
    assert W.skip_first(spark.range(5).withColumn("k", F.lit(1)), ["k"], ["id"], 0).count() == 5


def test_nan_is_the_largest_value(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", float("nan")), ("g", 3.0)], "g string, v double")
    assert Q.medians(df, ["g"], "v").first()["median"] == 3.0
