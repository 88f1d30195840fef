"""Domain jobs on small tables with published results."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldlab.functions import columns as C
from fieldlab.functions import water
from fieldlab.plans import chemistry, community, growth, loggers, respiro


def test_density_and_dry_weight(spark):
    # Weighings and their published density and dry weight.
    df = spark.createDataFrame([("PR1HH", 7.1194, 29.0, 36.6), ("LK10HL_2", 12.7285, 31.219, 36.5),
                                ("DI 1", 5.0, 29.0, 0.0), ("PA1", 5.0, None, 36.0)],
                               "id string, bw double, t double, s double")
    word = C.separate("id", " ", ["w"])["w"]
    d = growth.dry_weights(df, "id", "bw", "s", "t", F.when(F.col("id").contains("LK"), 2.71).otherwise(2.93),
                           word.isin("DI", "Air", "SW"))
    got = {r.id: (r.sw_dens, r.dry_weight) for r in d.collect()}
    assert set(got) == {"PR1HH", "LK10HL_2"}
    assert got["PR1HH"] == pytest.approx((1.023265973971582, 10.94009007824204), rel=1e-13)
    assert got["LK10HL_2"] == pytest.approx((1.0224275369036238, 20.4401504257243), rel=1e-13)


def test_growth_and_cleaning(spark, rows):
    # Dry weights and the published change, percent and daily rate.
    data = [("PR1HH", "PR", "pre", 10.94009007824204, "2/7/2023"), ("PR1HH", "PR", "post", 16.133311523796795, "4/6/2023"),
            ("PR2HH", "PR", "pre", 15.38523137111092, "2/7/2023"), ("PR2HH", "PR", "post", 19.898290678177887, "4/6/2023"),
            ("PR9", "PR", "pre", 5.0, "2/7/2023"), ("LC1", "LC", "pre", 5.0, "2/7/2023"), ("LC1", "LC", "post", 6.0, "4/6/2023"),
            ("HO1", "HO", "pre", 5.0, "2/7/2023"), ("HO1", "HO", "post", 4.9, "4/6/2023")]
    df = spark.createDataFrame(data, "id string, sp string, phase string, w double, d string").withColumn("d", C.parse_date("d"))
    g = growth.growth(df, ["id", "sp"], "phase", "w", "d", average=True)
    assert "PR9" not in {r.id for r in g.collect()}
    clean = growth.clean_growth(g, "sp", "change_pct", "mg_g_day", ["LC", "TO"], {"PR": 2, "GS": -5, "HO": 0})
    got = {r.id: (r.days, r.change, r.change_per_mass, r.change_pct, r.mg_g_day) for r in clean.collect()}
    assert set(got) == {"PR1HH", "PR2HH"}
    assert got["PR1HH"] == pytest.approx((58, 5.193221445554755, 0.4746964063744942, 47.469640637449416, 8.184420799560243), rel=1e-12)
    assert got["PR2HH"] == pytest.approx((58, 4.513059307066966, 0.29333710999895685, 29.33371099989569, 5.057536379292359), rel=1e-12)


def test_replicates_average_and_null_makes_null(spark):
    data = [("a", "pre", 1.0), ("a", "pre", 3.0), ("a", "post", 4.0), ("b", "pre", 1.0), ("b", "pre", None), ("b", "post", 2.0)]
    df = spark.createDataFrame(data, "id string, phase string, w double")
    got = {r.id: (r.pre, r.post) for r in growth.phase_change(df, ["id"], "phase", "w", average=True).collect()}
    assert got == {"a": (2.0, 4.0), "b": (None, 2.0)}


def test_pairs_need_both_members(spark, rows):
    df = spark.createDataFrame([("p1", "LOW", 1.0), ("p1", "HIGH", 2.0), ("p2", "LOW", 3.0), ("p3", "LOW", None), ("p3", "HIGH", 1.0)],
                               "pair string, et string, len double")
    assert {r[0] for r in rows(growth.complete_pairs(df, ["pair"]))} == {"p1", "p3"}
    assert {r[0] for r in rows(growth.complete_pairs(df, ["pair"], "len"))} == {"p1"}


def test_area_curves(spark):
    df = spark.createDataFrame([("wax", 3.6669), ("foil", 0.3038), ("other", 1.0)], "m string, w double")
    got = [r.area_cm2 for r in growth.surface_area(df, "m", "w").orderBy("m").collect()]
    assert got[0] == pytest.approx(70.7358) and got[1] is None and got[2] == pytest.approx(144.00234)


def test_assemblage_mass_merges_patches_and_stays_strict(spark):
    vol = spark.createDataFrame([("A1", "H", "x", 10.0), ("A1", "H", "y", None), ("B1", "H", "z", 5.0), ("B1", "H", "q", None)],
                                "unit string, et string, id string, v double")
    tins = spark.createDataFrame([("x", 1.0, 3.0, 2.0), ("x_2", 1.0, 2.5, 2.0), ("y", 1.0, 2.0, None), ("z", 1.0, 2.0, 1.5), ("unused", 1.0, 9.0, 2.0)],
                                 "id string, tin double, dry double, ash double")
    mass = tins.select("id", growth.ash_free_mass("tin", "dry", "ash").alias("m"))
    a = growth.assemblage_mass(vol, mass, ["unit", "et"], "id", "v", "m", {"x_2": "x"}, {"y": 21.0}, {"y": 1.4})
    got = {r.unit: (r.et, r.v, r.m) for r in a.collect()}
    assert got["A1"] == ("H", 31.0, pytest.approx(1.0 + 0.5 + 1.4))
    assert got["B1"] == ("H", None, pytest.approx(0.5))


def test_production_table(spark):
    # Rates of one run and their published production.
    data = [("A1_H", "LIGHT", 0.007606788476731552, 224.0, 7.779199999999997, 29.985425531914892, None),
            ("A1_H", "DARK", -0.011717839721254364, 224.0, 7.779199999999997, 29.87458, None),
            ("BLANK", "LIGHT", -4.235548703065644e-4, None, None, 29.89, 1), ("BLANK", "DARK", -3.2011275546157866e-4, None, None, 29.9, 1)]
    df = spark.createDataFrame(data, "unit string, light string, rate double, body double, afdw double, temp double, blank int")
    r = respiro.chamber_rates(df.withColumn("run", F.lit("R6")), "rate", "body")
    b = respiro.blank_corrected(r, ["run", "light"], F.col("blank") == 1, "amount_rate", "afdw")
    got = {x.metric: (x.light, x.rate_corr, x.rate_uncorr, x.temp)
           for x in respiro.production_table(b, ["unit"], "light", temp="temp").collect()}
    assert got["NP"] == ("LIGHT", pytest.approx(0.021508805798589447), pytest.approx(0.020332748466393102), pytest.approx(29.985425531914892))
    assert got["R"] == ("DARK", pytest.approx(0.030432645581795644), pytest.approx(0.03132148190403573), pytest.approx(29.87458))
    assert got["GP"] == ("LIGHT", pytest.approx(0.05194145138038509), pytest.approx(0.051654230370428836), pytest.approx(29.930002765957447))


def test_blank_corrects_itself_to_zero(spark):
    df = spark.createDataFrame([("r", 2.0, 1), ("r", 4.0, 1), ("r", 3.0, None)], "run string, rate double, blank int")
    b = respiro.blank_corrected(df.withColumn("m", F.lit(1.0)), ["run"], F.col("blank") == 1, "rate", "m")
    assert [x.rate_corr for x in b.collect()] == [0.0]


def test_net_calcification(spark):
    # Alkalinity of two chambers and the published rate.
    data = [("RUN2", 1, "INITIAL", 2354.4454, None, None), ("RUN2", 1, "B4", 2319.2309, 143.0, 2.732899999999999),
            ("RUN2", 2, "INITIAL", 2354.4454, None, None), ("RUN2", 2, "A4", 2315.539, 191.0, 6.077100000000001),
            ("RUN2", 8, "INITIAL", 2353.4005, None, None), ("RUN2", 8, "BLANK", 2342.5307, None, None)]
    df = spark.createDataFrame(data, "run string, ch int, grp string, ta double, body double, afdw double")
    df = df.withColumns({"vol": 6000 - F.col("body"), "h": F.lit(61.0 / 60.0)})
    nc = respiro.calcification(df, ["run"], ["run", "ch"], "grp", "ta", "vol", "afdw", "h")
    got = {r.grp: r.net_calcification for r in nc.collect()}
    assert got == {"B4": pytest.approx(26.249616563267256), "A4": pytest.approx(13.48333710315857)}
    assert respiro.drop_rerun(nc, "grp", "B4", "ch", 1).count() == 1


# A buffer calibration, mV by temperature.
BUFFER = [(-94.3, 16.0), (-89.6, 19.7), (-86.5, 21.9), (-83.9, 23.7), (-81.1, 25.8), (-78.3, 27.8),
          (-76.1, 29.4), (-74.7, 30.4), (-73.2, 31.5), (-72.2, 32.1), (-71.2, 32.9), (-70.7, 33.3)]


def test_total_ph(spark):
    buffer = spark.createDataFrame([("d", mv, t) for mv, t in BUFFER], "day string, mv double, t double")
    s = spark.createDataFrame([("d", 1, -83.6, 31.1, 35.9), ("d", 2, -81.9, 28.9, 35.3), ("d", 3, -77.8, 28.3, 35.9), ("e", 4, 1.0, 1.0, 1.0)],
                              "day string, i int, ex double, tt double, sal double")
    p = chemistry.ph_from_buffer(buffer, s, ["day"], "mv", "t", "ex", "tt", "sal").orderBy("i").collect()
    assert [r.ph for r in p[:3]] == pytest.approx([8.071043438237632, 8.05932065658939, 7.996733461599362], abs=1e-7)
    assert p[3].ph is None


def test_practical_salinity_check_value(spark):
    df = spark.createDataFrame([(42.914, 15.0 / 1.00024)], "c double, t double")
    # The printed coefficients reach the defining point to seven decimals.
    assert df.select(water.practical_salinity("c", "t", 0.0)).first()[0] == pytest.approx(35.0, abs=1e-6)


def test_drift_hits_both_references(spark):
    rows = [("l", i, 30.0 + i) for i in range(1, 11)] + [("m", 5, 1.0)]
    s = spark.createDataFrame(rows, "k string, t int, v double").withColumn("id", F.col("t"))
    refs = spark.createDataFrame([("l", 2, 9, 40.0, 50.0)], "k string, start int, stop int, ref_start double, ref_stop double")
    d = loggers.drift_corrected(s, refs, "k", "t", "id", "v", drop_last=False, rows_per_task=2).orderBy("t").collect()
    assert [r.t for r in d] == list(range(2, 10)) and {r.n for r in d} == {8}
    d1, d2 = 40.0 - 32.0, 50.0 - 39.0
    assert [r.corrected for r in d] == pytest.approx([30.0 + t + d1 + (t - 1) * (d2 - d1) / 8 for t in range(2, 10)])
    assert d[-1].corrected == pytest.approx(50.0)
    assert loggers.drift_corrected(s, refs, "k", "t", "id", "v").count() == 7


def test_offsets(spark):
    s = spark.createDataFrame([("l", t, float(t)) for t in range(5)], "k string, t int, v double")
    refs = spark.createDataFrame([("l", 3, 10.0)], "k string, at int, reference double")
    assert sorted((r.t, r.corrected) for r in loggers.offset_after(s, refs, "k", "t", "v").collect()) == [(3, 10.0), (4, 11.0)]
    one = spark.createDataFrame([("l", 1, 3, 12.0)], "k string, start int, stop int, reference double")
    assert [r.calibrated for r in loggers.one_point_calibration(s, one, "k", "t", "v").orderBy("t").collect()] == [10.0, 11.0, 12.0, 13.0, 14.0]


def test_dominant_taxa_excludes_after_the_share(spark):
    df = spark.createDataFrame([("High", "turf", 50.0), ("High", "a", 30.0), ("High", "b", 20.0), ("Low", "b", 5.0), ("Low", "x", 5.0)],
                               "site string, taxon string, n double")
    unused = spark.createDataFrame([("turf",)], "taxon string")
    known = spark.createDataFrame([("turf",), ("a",), ("b",)], "taxon string")
    t = community.dominant_taxa(df, "site", "taxon", "n", 1, unused, known=known)
    assert sorted((r.site, r.taxon, r.cover) for r in t.collect()) == [("High", "a", 30.0), ("Low", "b", 100.0)]


def test_trait_decode(spark):
    df = spark.createDataFrame([("Rhodophyta,Br,NC,Auto",), ("Porifera,Odd,NC,Het",)], "fe string")
    got = [tuple(r) for r in community.decode_traits(df, "fe").drop("fe").collect()]
    assert got == [("Rhodophyta", "Branching", "Non-calcifying", "Autotrophic"), ("Porifera", "Odd", "Non-calcifying", "Heterotrophic")]


def test_nutrient_summary(spark):
    # Nitrate plus nitrite of two sites, mean and SE known.
    df = spark.createDataFrame([("Seep_DL_2023", 11.5), ("HighFlow_DL_x", 1.0), ("HighFlow_DH_x", 2.0), ("LowFlow_DH_x", 3.0)], "s string, nn double")
    got = {r.site: (r.mean, r.se) for r in chemistry.nutrient_summary(df, "s", ["nn"], ["Seep"], {"HighFlow": "High"}).collect()}
    assert got == {"High": (1.5, pytest.approx(0.5)), "LowFlow": (3.0, None)}


def test_two_channel_calibration(spark):
    from fieldlab.functions import water
    from fieldlab.plans import loggers
    day = datetime.datetime(2024, 1, 1)
    at = lambda h: day + datetime.timedelta(hours=h)
    series = spark.createDataFrame([(k, at(h), 50.0 + k + h, 24.0 + h) for k in range(6) for h in range(5)], "k int, t timestamp_ntz, ec double, temp double")
    refs = spark.createDataFrame([(0, 60.0, 26.0, "EC", at(1), at(3)), (1, 60.0, 26.0, "sc", at(1), at(3)), (2, 60.0, None, "SC", at(1), at(3)),
                                  (3, 60.0, None, "EC", at(9), at(10)), (4, 60.0, 26.0, "??", at(1), at(3))],
                                 "k int, reference double, reference_temperature double, flag string, start timestamp_ntz, stop timestamp_ntz")
    got = {(r.k, r.t): r for r in loggers.two_channel_calibration(series, refs, "k", "t", "ec", "temp").collect()}
    assert len(got) == 30
    sc = lambda c, t: c / (1 + 0.0191 * (t - 25))
    for h in range(5):  # means of the window are those of hour 2
        r = got[0, at(h)]
        assert r.temperature_cal == pytest.approx(24.0 + h) and r.conductivity_cal == pytest.approx(60.0 + h - 2)
        assert r.specific_cal == pytest.approx(sc(60.0 + h - 2, 24.0 + h))
        r = got[1, at(h)]
        assert r.conductivity_cal == pytest.approx(60.0 * (1 + 0.0191) + h - 2)
        assert got[2, at(h)].temperature_cal == 24.0 + h
        assert all(got[k, at(h)].conductivity_cal is None and got[k, at(h)].specific_cal is None for k in (3, 4, 5))
    assert got[1, at(2)].specific_cal == pytest.approx(60.0) and got[2, at(2)].specific_cal == pytest.approx(60.0)
    both = spark.createDataFrame([(52.0, 3.5), (40.0, 31.0), (0.0, 25.0)], "c double, t double")
    assert all(r.c == pytest.approx(r.back) for r in both.withColumn("back", water.conductivity_at(water.specific_conductance("c", "t"), "t")).collect())
