"""Statistics: closed-form identities, brute force, and printed tables."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from reml import Reml
from pyspark.sql import functions as F

from fieldlab.functions import tails
from fieldlab.functions.normal import normal_quantile, normal_upper
from fieldlab.functions.studentised import range_tails
from fieldlab.plans import anova, charts, mixed, regression
from fieldlab.plans.local_regression import best_window, ranked_local_regression


def test_tails_against_closed_forms_and_tables():
    assert tails.f_sf(5.0, 2, 33) == pytest.approx((1 + 10 / 33) ** -16.5, rel=1e-12)
    x = 9995 / (9995 + 8)
    assert tails.f_sf(2.0, 4, 9995) == pytest.approx(x ** 4997.5 * (1 + 4997.5 * (1 - x)), rel=1e-9)
    assert tails.t_sf2(1.0, 1) == pytest.approx(0.5)
    assert tails.t_quantile(0.975, [1, 2, 10, 100]) == pytest.approx([12.7062047, 4.3026527, 2.2281389, 1.9839715], abs=1e-6)
    # Printed 5 % points of the studentised range.
    for k, df, q in ((3, 10, 3.877), (3, 2, 8.331), (4, 5, 5.218), (5, 1e6, 3.858)):
        assert tails.tukey_sf(q, k, df)[0] == pytest.approx(0.05, abs=1e-4)
    # Two means: the range is sqrt 2 times |t|.
    assert tails.tukey_sf(math.sqrt(2) * 2.5, 2, 12)[0] == pytest.approx(float(tails.t_sf2(2.5, 12)), abs=1e-9)
    assert math.isnan(tails.f_sf(np.nan, 1, 5))


def test_studentised_range_at_any_size_and_far_out():
    # No step at any size: the change from one degree of freedom to the next is that of the neighbours.
    for q in (3.5, 6.0):
        a, b, c, d = (tails.tukey_sf(q, 5, df)[0] for df in (24998, 24999, 25001, 25002))
        assert abs(b - c) < 3 * max(abs(a - b), abs(c - d)) < 1e-4 * a
        assert tails.tukey_sf(q, 5, 1e9)[0] == pytest.approx(tails.tukey_sf(q, 5, math.inf)[0], rel=1e-6)
    # Two means: the range is sqrt 2 times |t|, also where the tail is far below the rounding of one.
    for t, df in ((2.5, 1), (2.5, 7), (12.0, 40), (12.0, 24999), (12.0, 25001), (15.0, 1e6), (60.0, 12)):
        assert tails.tukey_sf(math.sqrt(2) * t, 2, df)[0] == pytest.approx(float(tails.t_sf2(t, df)), rel=1e-7, abs=0)


def test_normal_quantile_column(spark):
    p = [1e-12, 1e-6, 0.01, 0.2, 0.5, 0.9, 0.975, 1 - 1e-9]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    got = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-12, abs=1e-14)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 90
    p = pd.DataFrame({"id": np.arange(n), "a": rng.choice(["LOW", "HIGH", "MID"], n), "b": rng.choice(["x", "y"], n),
                      "z": rng.normal(size=n), "w": rng.normal(size=n)})
    p["y"] = 2 + 0.5 * p.z + (p.a == "LOW") * 1.2 + rng.normal(size=n)
    return spark.createDataFrame(p), p


def design(p, terms):
    return np.column_stack([np.ones(len(p)), *terms])


def rss(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return float(np.sum((y - x @ b) ** 2))


def test_two_way_parts_follow_the_order_and_add_up(data):
    df, p = data
    got = {r.source: r for r in anova.two_way(df, [], "a", "b", "y").collect()}
    da = [(p.a == v).astype(float) for v in ("LOW", "MID")]
    db = [(p.b == "y").astype(float)]
    y = p.y.to_numpy()
    steps = [rss(design(p, t), y) for t in ([], da, da + db, da + db + [u * db[0] for u in da])]
    assert [got[s].ss for s in ("a", "b", "a x b", "residual")] == pytest.approx(
        [steps[0] - steps[1], steps[1] - steps[2], steps[2] - steps[3], steps[3]])
    assert sum(r.ss for r in got.values()) == pytest.approx(np.sum((y - y.mean()) ** 2))
    assert [got[s].df for s in ("a", "b", "a x b", "residual")] == [2, 1, 2, 84]
    assert got["residual"].f_value is None


def test_two_levels_give_t_squared(data):
    df, p = data
    row = anova.one_way(df, [], "b", "y").first()
    x, y = p.y[p.b == "x"], p.y[p.b == "y"]
    s2 = (x.var() * (len(x) - 1) + y.var() * (len(y) - 1)) / (len(p) - 2)
    t = (x.mean() - y.mean()) / math.sqrt(s2 * (1 / len(x) + 1 / len(y)))
    assert row.f_value == pytest.approx(t * t)
    assert row.p == pytest.approx(float(tails.t_sf2(t, len(p) - 2)))
    c = anova.pairwise(df, [], ["b"], "y").first()
    assert (c.t_ratio, c.p_adj) == (pytest.approx(t), pytest.approx(row.p, abs=1e-8))


def test_empty_cell_lowers_the_rank(spark):
    p = pd.DataFrame({"a": list("ppqqpp"), "b": list("xyxxyx"), "y": [1.0, 2.0, 4.0, 5.0, 2.5, 1.5]})
    got = {r.source: r.df for r in anova.two_way(spark.createDataFrame(p), [], "a", "b", "y").collect()}
    assert got == {"a": 1.0, "b": 1.0, "a x b": 0.0, "residual": 3.0}


def test_linear_model_table(data):
    df, p = data
    got = {r.term: r for r in regression.linear_model(df, [], "y", {"z": F.col("z"), "low": F.col("a") == "LOW"}).collect()}
    x = design(p, [p.z, (p.a == "LOW").astype(float)])
    y = p.y.to_numpy()
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = rss(x, y) / (len(p) - 3)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2)
    for i, t in enumerate(("intercept", "z", "low")):
        assert (got[t].estimate, got[t].std_error) == (pytest.approx(b[i]), pytest.approx(se[i]))
        assert got[t].p == pytest.approx(float(tails.t_sf2(b[i] / se[i], len(p) - 3)))
    assert got["z"].r2 == pytest.approx(1 - rss(x, y) / np.sum((y - y.mean()) ** 2))


def test_line_and_band(data):
    df, p = data
    f = regression.line_fit(df, ["b"], "z", "y", p_value=True).filter("b = 'x'").first()
    q = p[p.b == "x"]
    x = design(q, [q.z])
    cov = np.linalg.inv(x.T @ x) * rss(x, q.y.to_numpy()) / (len(q) - 2)
    beta = np.linalg.lstsq(x, q.y.to_numpy(), rcond=None)[0]
    assert (f.intercept, f.slope) == pytest.approx(tuple(beta))
    assert (f.se_intercept, f.se_slope) == pytest.approx(tuple(np.sqrt(np.diag(cov))))
    band = regression.line_band(df, ["b"], "z", "y", points=5).filter("b = 'x'").orderBy("grid").collect()
    at = np.array([1.0, band[3].x])
    half = float(tails.t_quantile(0.975, len(q) - 2)) * math.sqrt(at @ cov @ at)
    assert band[3].high - band[3].fit == pytest.approx(half) and band[0].x == pytest.approx(q.z.min())


def test_complete_pairs_give_the_paired_t(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 3, 12)
    low, high = base + rng.normal(size=12), base + 1 + rng.normal(size=12)
    p = pd.DataFrame({"k": "s", "pair": list(range(12)) * 2, "x": [0.0] * 12 + [1.0] * 12, "y": np.concatenate([low, high])})
    r = mixed.random_intercept(spark.createDataFrame(p), ["k"], ["pair"], "x", "y").first()
    d = high - low
    t = d.mean() / (d.std(ddof=1) / math.sqrt(12))
    assert r.ratio > 0
    assert (r.estimate, r.f_value) == (pytest.approx(d.mean()), pytest.approx(t * t, rel=1e-6))
    assert r.den_df == pytest.approx(11, rel=1e-4)
    assert r.p == pytest.approx(float(tails.t_sf2(t, 11)), rel=1e-3)


def test_no_cluster_effect_falls_back_to_the_plain_model(spark):
    p = pd.DataFrame({"k": "s", "pair": [0, 0, 1, 1, 2, 2, 3, 3], "x": [0.0, 1.0] * 4, "y": [1.0, 5.0, 5.2, 1.1, 1.2, 4.8, 5.1, 0.8]})
    r = mixed.random_intercept(spark.createDataFrame(p), ["k"], ["pair"], "x", "y").first()
    assert (r.ratio, r.den_df) == (0.0, 6.0)
    lm = regression.line_fit(spark.createDataFrame(p), ["k"], "x", "y").first()
    assert r.f_value == pytest.approx(lm.t_slope ** 2)


def test_mixed_likelihood_against_the_dense_form(spark):
    rng = np.random.default_rng(9)
    pair = rng.integers(0, 10, 40)
    x = rng.integers(0, 2, 40).astype(float)
    y = x + rng.normal(size=10)[pair] + rng.normal(size=40)
    sums = mixed.size_classes(spark.createDataFrame(pd.DataFrame({"k": 1, "pair": pair, "x": x, "y": y})), ["k"], ["pair"], "x", "y")
    model = Reml(sums.toPandas())
    theta = 0.7
    v = np.eye(40) + theta * (pair[:, None] == pair[None, :])
    d = np.column_stack([np.ones(40), x - x.mean()])
    vi = np.linalg.inv(v)
    a = d.T @ vi @ d
    yc = y - y.mean()
    b = np.linalg.solve(a, d.T @ vi @ yc)
    slope, unit, q, log_det = model.parts(theta)
    assert slope == pytest.approx(b[1]) and unit == pytest.approx(np.linalg.inv(a)[1, 1])
    assert q == pytest.approx((yc - d @ b) @ vi @ (yc - d @ b))
    assert log_det == pytest.approx(np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1])
    h = 1e-5
    assert model.gradient(theta) == pytest.approx((model.profile(theta + h) - model.profile(theta - h)) / (2 * h), rel=1e-6)


def test_all_keys_at_once_as_one_by_one(spark):
    """Weak, strong and no clusters, a null key, unequal sizes, and keys that can't be fitted."""
    rng = np.random.default_rng(21)
    parts = []
    for n, (key, spread) in enumerate([("none", 0.0), ("weak", 0.4), ("strong", 5.0), (None, 1.0), ("huge", 1e7)]):
        pair = rng.integers(0, 8 + 3 * n, 60)
        x = rng.integers(0, 2, 60).astype(float)
        parts.append(pd.DataFrame({"k": key, "pair": pair, "x": x, "y": 0.5 * x + spread * rng.normal(size=40)[pair] + rng.normal(size=60)}))
    flat = pd.DataFrame({"k": "flat", "pair": [0, 0, 1], "x": 1.0, "y": [1.0, 2.0, 4.0]})
    few = pd.DataFrame({"k": "few", "pair": [0, 1], "x": [0.0, 1.0], "y": [1.0, 2.0]})
    df = spark.createDataFrame(pd.concat([*parts, flat, few]), "k string, pair long, x double, y double")
    got = {r.k: r for r in mixed.random_intercept(df, ["k"], ["pair"], "x", "y").collect()}
    sums = mixed.size_classes(df, ["k"], ["pair"], "x", "y").toPandas()
    assert set(got) == {"none", "weak", "strong", None, "huge", "flat", "few"}
    for part in parts:
        key = part.k.iloc[0]
        model = Reml(sums[sums.k.isna()] if key is None else sums[sums.k == key])
        theta, r = model.ratio(), got[key]
        slope, unit, q, _ = model.parts(theta)
        s2 = q / 58.0
        assert r.ratio == pytest.approx(theta, rel=1e-6, abs=1e-12) and r.estimate == pytest.approx(slope, rel=1e-6)
        assert r.f_value == pytest.approx(slope ** 2 / (s2 * unit), rel=1e-5)
        if key != "huge":
            assert r.den_df == pytest.approx(model.denominator_df(math.sqrt(theta), math.sqrt(s2)), rel=1e-4)
            assert r.p == pytest.approx(float(tails.f_sf(r.f_value, 1.0, r.den_df)), rel=1e-6)
    assert [k for k, r in got.items() if r.at_limit] == ["huge"] and got["strong"].ratio > got["weak"].ratio
    assert got["flat"].estimate is None and got["flat"].p is None and got["few"].residual_variance is None
    empty = mixed.random_intercept(df.limit(0), [], ["pair"], "x", "y")
    assert empty.columns[:2] == ["estimate", "ratio"] and empty.count() == 0


def test_levene_uses_medians(spark, data):
    df, p = data
    away = p.assign(d=(p.y - p.groupby("a").y.transform("median")).abs())
    want = anova.one_way(spark.createDataFrame(away), [], "a", "d").first()
    got = anova.levene(df, [], ["a"], "y").first()
    assert got.f_value == pytest.approx(want.f_value) and got.p == pytest.approx(want.p)


def test_shapiro_known_samples(spark):
    # The weights of eleven men, W = 0.79 in the original paper.
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("m", float(v)) for v in men] + [("u", float(v)) for v in (1, 2)]
                               + [("one", 4.0)] + [("flat", 4.0)] * 6
                               + [("t", float(v)) for v in (1, 2, 3)], "g string, v double")
    got = {r.g: r for r in anova.shapiro_wilk(df, ["g"], "v").collect()}
    assert got["m"].w == pytest.approx(0.7888, abs=2e-4) and got["m"].p == pytest.approx(0.0067, abs=2e-4)
    assert got["u"].w is None and got["u"].p is None and got["t"].w == pytest.approx(1.0)
    big = spark.range(6000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    r = anova.shapiro_wilk(big, ["g"], "v").first()
    assert got["one"].w is got["flat"].w is got["flat"].p is None and got["m"].p_published and not r.p_published
    assert r.n == 6000 and 0.9 < r.w < 1 and 0 <= r.p < 0.001


def test_shapiro_p_on_both_sides_of_the_published_range(spark):
    p = [anova.shapiro_wilk(spark.range(n).select(F.lit("g").alias("g"), normal_quantile((F.col("id") + 0.5) / n).alias("v")),
                            ["g"], "v").first().p for n in (4999, 5001)]
    assert p[0] == pytest.approx(p[1], abs=1e-3)


def test_cells_with_colliding_labels_stay_apart(spark):
    rows = [(a, b, float(i + j)) for j, (a, b) in enumerate([("a b", "c"), ("a", "b c"), ("d", "e")]) for i in range(4)]
    df = spark.createDataFrame(rows, "f string, g string, y double")
    assert anova.pairwise(df, [], ["f", "g"], "y").count() == 3


def test_f_tail_of_large_degrees_of_freedom():
    assert float(tails.f_sf(1.0, 1e7, 1e9)) == pytest.approx(0.499941, abs=2e-6)


def test_qq_points_and_ties(spark):
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate([2.0, 1.0, 2.0, 2.0])], "g string, v double, id int")
    got = [(r.v, r.i, round(r.theoretical, 6)) for r in anova.qq_points(df, ["g"], "v", ["id"]).orderBy("i").collect()]
    assert got == [(v, i, round(NormalDist().inv_cdf((i - 0.5) / 4), 6)) for v, i in ((1.0, 1), (2.0, 2), (2.0, 3), (2.0, 4))]


def test_diagnostics(data):
    df, p = data
    got = anova.two_way_diagnostics(df, "a", "b", "y").orderBy("id").toPandas()
    g = p.groupby(["a", "b"]).y
    fit, n = g.transform("mean"), g.transform("size")
    mse = ((p.y - fit) ** 2).sum() / (len(p) - 6)
    std = (p.y - fit) / np.sqrt(mse * (1 - 1 / n))
    assert np.allclose(got.std_residual, std)
    assert np.allclose(got.cooks_distance, std ** 2 * (1 / n) / ((1 - 1 / n) * 6))


def test_letters(spark):
    rng = np.random.default_rng(5)
    p = pd.concat([pd.DataFrame({"f": f, "y": m + rng.normal(0, 1, 40)}) for f, m in (("a", 0.0), ("b", 0.1), ("c", 5.0), ("d", 10.0))])
    got = {r.f: r.letters for r in anova.grouping_letters(spark.createDataFrame(p), [], "f", "y").collect()}
    assert got["d"] == "a" and got["c"] == "b" and got["a"] == got["b"] == "c"
    overlap = anova._letters(["x", "y", "z"], np.array([[0, 0, 1], [0, 0, 0], [0, 0, 0]], bool))
    assert overlap == ["a", "ab", "b"]


def test_normal_upper_column(spark):
    z = [-9.0, -1.5, 0.0, 0.3, 2.0, 6.9, 7.2, 20.0, 36.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(normal_upper(F.col("z"))).collect()]
    assert got == pytest.approx([0.5 * math.erfc(v / math.sqrt(2)) for v in z], rel=1e-8, abs=0)


def test_range_tails_relation(spark):
    rows = [(q, k, float(v)) for q in (0.05, 2.0, 3.8, 9.0, 30.0) for k in (2, 5, 40, 500) for v in (1, 2, 7, 40, 60000)]
    odd = [(None, 3, 5.0), (0.0, 3, 5.0), (2.0, 3, 0.0), (float("nan"), 3, 5.0), (2.0, 3, 7.0), (2.0, 3, 7.0)]
    got = range_tails(spark.createDataFrame(rows + odd, "q double, k int, v double"), "q", "k", "v").collect()
    assert len(got) == len(rows + odd)
    for r in got:
        if r.q == 0.0:
            assert r.p == 1.0
        elif r.q is None or math.isnan(r.q) or r.v == 0.0:
            assert r.p is None
        else:
            assert r.p == pytest.approx(tails.tukey_sf(r.q, r.k, r.v)[0], rel=1e-7, abs=1e-9), r
    assert tails.tukey_sf(tails.tukey_point(0.05, 7, 30), 7, 30)[0] == pytest.approx(0.05, rel=1e-10)


def test_letters_are_the_largest_sets_without_a_difference():
    rng = np.random.default_rng(8)
    for k in (1, 2, 5, 8):
        for share in (0.1, 0.5, 0.9):
            different = np.triu(rng.random((k, k)) < share, 1)
            free = [z for z in range(1, 2 ** k) if not any(different[i, j] and z >> i & z >> j & 1 for i in range(k) for j in range(i + 1, k))]
            top = [z for z in free if not any(o != z and o & z == z for o in free)]
            order = sorted(top, key=lambda z: [i for i in range(k) if z >> i & 1])
            want = ["".join(chr(97 + n) if n < 26 else chr(39 + n) for n, z in enumerate(order) if z >> i & 1) for i in range(k)]
            assert anova._letters(list(range(k)), different) == want


def test_letters_of_many_levels(spark):
    rows = spark.range(500 * 6).select((F.col("id") % 500).alias("f"), ((F.col("id") % 500) * 0.02 + (F.col("id") / 500).cast("int") % 3).alias("y"))
    got = anova.grouping_letters(rows, [], "f", "y").orderBy(F.desc("mean")).collect()
    assert len(got) == 500 and got[0].letters.startswith("a") and not set(got[0].letters) & set(got[-1].letters)


def test_display_table(data):
    df, _ = data
    t = {r.source: r for r in anova.display_table(anova.two_way(df, [], "a", "b", "y"), ["source"], ["df", "ss", "ms"]).collect()}
    assert t["residual"].f_value == "-" and t["residual"].p == "-"
    assert t["a"].p.split(" ")[1] in ("*", "**", "***")


def brute_force(x, y, alpha):
    rows, n = [], len(x)
    for i in range(n):
        for j in range(i + max(3, int(alpha * n)) - 1, n):
            u, v = x[i:j + 1], y[i:j + 1]
            d = np.column_stack([np.ones(len(u)), u])
            b = np.linalg.lstsq(d, v, rcond=None)[0]
            e = v - d @ b
            s = e @ e
            aux = np.column_stack([d, np.concatenate([[0.0], e[:-1]])])
            left = e - aux @ np.linalg.lstsq(aux, e, rcond=None)[0]
            width = 2 * float(tails.t_quantile(0.975, len(u) - 2)) * math.sqrt(s / (len(u) - 2) / np.sum((u - u.mean()) ** 2))
            rows.append((i, j, b[0], b[1], abs(np.mean(e ** 3) / np.mean(e ** 2) ** 1.5), 1 - left @ left / s, width))
    a = np.array(rows)
    rank = sum(np.floor(pd.Series(a[:, c]).rank()) for c in (4, 5, 6)).to_numpy()
    k = rank.argmin()
    return (*a[k, :4], rank[k] / len(a) / 3)


def test_local_regression_against_brute_force():
    rng = np.random.default_rng(1)
    x = np.arange(1, 46) * 20.0
    y = 100 - 0.01 * x + rng.normal(0, 0.1, 45)
    y[:10] += np.linspace(3, 0, 10)
    assert best_window(x, y, 0.5) == pytest.approx(brute_force(x, y, 0.5))
    assert best_window(x[:2], y[:2], 0.5) == (None,) * 5


def test_long_series_path_gives_the_same_windows(spark):
    rng = np.random.default_rng(3)
    parts = []
    for f, n in (("a", 110), ("b", 75), ("c", 30)):
        x = np.arange(1.0, n + 1)
        y = 50 - 0.2 * x + rng.normal(0, 0.5, n)
        y[:n // 5] += np.linspace(6, 0, n // 5)
        parts.append(pd.DataFrame({"f": f, "x": x, "y": y, "temp": 20.0}))
    df = spark.createDataFrame(pd.concat(parts))
    want = ranked_local_regression(df, "f", "x", "y", mean_of="temp").orderBy("f").collect()
    got = ranked_local_regression(df, "f", "x", "y", mean_of="temp", series_points=50, block=32, candidates=20).orderBy("f").collect()
    assert [(r.f, r.start_row, r.stop_row) for r in got] == [(r.f, r.start_row, r.stop_row) for r in want]
    for g, w in zip(got, want):
        assert (g.intercept, g.slope, g.score, g.mean_temp) == pytest.approx((w.intercept, w.slope, w.score, w.mean_temp))


def test_chart_tables(spark):
    df = spark.createDataFrame([("g", 0.0), ("g", 1.0), ("h", 10.0), ("h", 5.0)], "k string, v double")
    h = sorted((r.k, r.bin, r.n) for r in charts.histogram(df, ["k"], "v", bins=10).collect())
    assert h == [("g", 0, 1), ("g", 1, 1), ("h", 5, 1), ("h", 9, 1)]
    e = {r.k: (r.low, r["mean"], r.high) for r in charts.error_bars(df, ["k"], "v").collect()}
    assert e["g"] == pytest.approx((0.0, 0.5, 1.0))
    pairs = spark.createDataFrame([(1, "LOW", 2.0), (1, "HIGH", 3.0), (2, "LOW", 1.0)], "p int, et string, v double")
    assert [tuple(r) for r in charts.pair_lines(pairs, ["p"], "et", ["LOW", "HIGH"], "v").collect()] == [(1, 2.0, 3.0)]
