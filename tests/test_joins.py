"""Null-safe joins, intervals and exclusion windows."""

import pytest
from pyspark.sql import functions as F

from fieldlab.operators import joins as J


@pytest.fixture
def pair(spark):
    a = spark.createDataFrame([(1, "x", 10), (None, "y", 20), (3, "z", 30)], "k int, s string, a int")
    b = spark.createDataFrame([(1, 100), (None, 200), (4, 400)], "k int, b int")
    return a, b


def test_null_matches_null(pair, rows):
    a, b = pair
    assert rows(J.natural_join(a, b, "left")) == [(1, "x", 10, 100), (3, "z", 30, None), (None, "y", 20, 200)]
    assert rows(J.natural_join(a, b, "right")) == [(1, "x", 10, 100), (4, None, None, 400), (None, "y", 20, 200)]
    assert rows(J.natural_join(a, b, "full")) == [
        (1, "x", 10, 100), (3, "z", 30, None), (4, None, None, 400), (None, "y", 20, 200)]
    assert rows(J.anti_join(a, b)) == [(3, "z", 30)]
    assert rows(J.semi_join(a, b)) == [(1, "x", 10), (None, "y", 20)]


def test_names_differing_in_case_are_refused(spark):
    with pytest.raises(ValueError):
        J.natural_join(spark.sql("select 1 k, 2 Notes"), spark.sql("select 1 k, 2 notes"))
    with pytest.raises(ValueError):
        J.natural_join(spark.sql("select 1 a"), spark.sql("select 1 b"))


def test_shared_names_outside_the_key_get_suffixes(spark):
    a, b = spark.sql("select 1 k, 2 v"), spark.sql("select 1 k, 3 v")
    assert J.natural_join(a, b, "inner", ["k"], ("_a", "_b")).columns == ["k", "v_a", "v_b"]


def test_interval_ends_are_included(spark, rows):
    r = spark.createDataFrame([("f", i) for i in range(6)] + [("g", 1)], "f string, t int")
    w = spark.createDataFrame([("f", 2, 4), ("h", 0, 9)], "f string, start int, stop int")
    want = [("f", 2, 2, 4), ("f", 3, 2, 4), ("f", 4, 2, 4)]
    assert rows(J.interval_join(r, w, ["f"], "t")) == want
    assert rows(J.interval_join(r, w, ["f"], "t", many=True)) == want


def test_excluded_and_kept_rows_make_up_the_input(spark):
    r = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), "id",
        (F.lit("2023-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id") * 5))
        .cast("timestamp_ntz").alias("t"))
    w = spark.createDataFrame([("a", "2023-03-02 01:10:00", "2023-03-03 02:00:00"),
                               (None, "2023-03-05 00:00:00", "2023-03-05 00:00:00"),
                               ("b", "2023-03-06 23:55:00", "2023-03-07 00:05:00")], "g string, s string, e string")
    w = w.select("g", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("stop"))
    kept = J.exclude_windows(r, w, "g", "t")
    hit = r.join(w.withColumnRenamed("g", "wg"), (F.col("t") >= F.col("start")) & (F.col("t") <= F.col("stop"))
                 & (F.col("wg").isNull() | (F.col("wg") == F.col("g"))), "left_semi")
    assert hit.count() > 0
    assert kept.count() + hit.count() == 5000
    assert kept.join(hit, "id").count() == 0


def test_lookup_and_align(spark, rows):
    s = spark.createDataFrame([("l", 1, 5.0), ("l", 2, 6.0), ("m", 1, 7.0)], "k string, t int, v double")
    at = spark.createDataFrame([("l", 2), ("m", 3)], "k string, t int")
    assert rows(J.lookup_at(s, at, ["k"], "t")) == [("l", 2, 6.0)]
    d = spark.createDataFrame([("l", 2, 1.5), ("n", 9, 2.5)], "k string, t int, depth double")
    assert len(rows(J.align(s, d, ["k", "t"]))) == 4


def test_broadcast_only_when_counted_small(spark):
    from fieldlab.session import small_side
    big, small = spark.range(1000), spark.range(10)
    plan = big.join(small_side(small, max_rows=10), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = big.join(small_side(small, max_rows=9), "id")._jdf.queryExecution().toString()
        assert "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_open_windows_have_no_bound(spark):
    r = spark.createDataFrame([("a", "2024-01-01 10:00:00"), ("b", "2024-01-02 10:00:00")], "k string, t string")
    r = r.withColumn("t", F.col("t").cast("timestamp_ntz"))
    w = spark.createDataFrame([("a", None, "2024-01-01 12:00:00"), ("b", "2024-01-02 09:00:00", None)], "k string, start string, stop string")
    w = w.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})
    assert J.exclude_windows(r, w, "k", "t").count() == 0


def test_windows_of_any_length_have_two_pieces(spark):
    import random
    rng = random.Random(2)
    windows = [(a, a + rng.choice([0, 1, 5, 63, 10 ** 4, 10 ** 7])) for a in (rng.randrange(-10 ** 6, 10 ** 6) for _ in range(60))]
    windows += [(0, 10 * 366 * 24 * 60), (-8, -1), (-1, 0), (-2 ** 40, 2 ** 40)]
    df = spark.createDataFrame(windows, "a long, b long")
    for r in df.select("a", "b", J.grid_pieces(F.col("a"), F.col("b")).alias("p")).collect():
        assert 1 <= len(r.p) <= 2 and len({p.level for p in r.p}) == 1
        for slot in (r.a, r.b, (r.a + r.b) // 2):
            assert any(p.place == slot >> p.level for p in r.p)
        assert 1 << r.p[0].level < 8 * (r.b - r.a + 1)


def test_long_and_open_windows(spark):
    import datetime
    import random
    rng = random.Random(7)
    day = datetime.datetime(2015, 1, 1)
    when = lambda h: day + datetime.timedelta(seconds=h)
    ten_years = 3653 * 86400
    readings = [(i, rng.choice(["a", "b", None]), None if i % 50 == 0 else when(rng.randrange(-ten_years, 2 * ten_years) + rng.random())) for i in range(800)]
    readings += [(1000, "a", when(0)), (1001, "a", when(ten_years)), (1002, "b", when(5)), (1003, "b", when(5.000001))]
    windows = [("a", when(0), when(ten_years)), ("b", None, when(5)), (None, when(int(1.9 * ten_years)), None), ("b", when(10), when(9)), ("c", None, None)]
    r = spark.createDataFrame(readings, "id int, k string, t timestamp_ntz")
    w = spark.createDataFrame(windows, "k string, start timestamp_ntz, stop timestamp_ntz")
    hit = lambda k, t: t is not None and any((wk is None or wk == k) and (lo is None or t >= lo) and (hi is None or t <= hi) for wk, lo, hi in windows)
    assert {x.id for x in J.exclude_windows(r, w, "k", "t").collect()} == {i for i, k, t in readings if not hit(k, t)}
