"""Column helpers and the NULL and rounding rules they carry."""

import datetime

import pytest
from pyspark.sql import functions as F

from fieldlab.functions import columns as C
from fieldlab.operators import verbs


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'double' if isinstance(v, float) or v is None else 'string'}" for k, v in values.items()))
    return tuple(df.select(*cols).first())


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(C.clamp_zero("x")).collect()] == [0.0, 2.0, None]


def test_recode_keeps_unknown_and_null(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    assert [r[0] for r in df.select(C.recode("x", {"a": "A"})).collect()] == ["A", "z", None]
    assert [r[0] for r in df.select(C.recode("x", {"a": "A"}, default="")).collect()] == ["A", "", ""]


def test_unite_prints_or_skips_null(spark):
    assert one(spark, C.unite(["a", "b"]), C.unite(["a", "b"], skip_null=True), a="x", b=None) == ("x_NA", "x")


def test_separate_fills_and_drops(spark):
    parts = C.separate("a", "_", ["one", None, "three", "four"])
    assert one(spark, *parts.values(), a="x_y_z") == ("x", "z", None)
    assert one(spark, *C.separate("a", ".", ["p", "q"]).values(), a="1.5") == ("1", "5")


@pytest.mark.parametrize("text, want", [
    ("3/5/2023 7:04", datetime.datetime(2023, 3, 5, 7, 4)),
    ("3/5/2023 17:04:09", datetime.datetime(2023, 3, 5, 17, 4, 9)),
    ("2023-03-05 07:04:00", datetime.datetime(2023, 3, 5, 7, 4)),
    ("Date Time", None), ("", None)])
def test_parse_time(spark, text, want):
    assert one(spark, C.parse_time("a"), a=text)[0] == want


def test_days_count_across_new_year(spark):
    df = spark.sql("select date'2022-12-20' a, date'2023-01-10' b")
    assert df.select(F.datediff("b", "a")).first()[0] == 21


def test_elapsed_and_ratio(spark):
    df = spark.sql("select timestamp_ntz'2023-01-01 10:00:00' a, timestamp_ntz'2023-01-01 11:30:00' b")
    assert df.select(C.elapsed("a", "b", "h")).first()[0] == 1.5
    assert one(spark, C.ratio("a", F.lit(0.0)), C.percent_change(F.lit(3.0), "a"), a=2.0) == (None, 50.0)


def test_signif_and_stars(spark):
    df = spark.createDataFrame([(0.0,), (123456.0,), (-0.00123456,), (None,)], "x double")
    assert [r[0] for r in df.select(C.signif("x", 2)).collect()] == [0.0, 120000.0, -0.0012, None]
    p = spark.createDataFrame([(0.0005,), (0.005,), (0.02,), (0.05,), (None,)], "p double")
    assert [r[0] for r in p.select(C.stars("p")).collect()] == ["***", "**", "*", "", None]


def test_celsius_patch_ladder_suffix(spark):
    df = spark.createDataFrame([("k", 86.0), ("m", 28.0)], "k string, v double")
    assert [tuple(r) for r in df.select(C.celsius("v"), C.patch_value("k", "v", {"m": 1.0})).collect()] == [
        (30.0, 86.0), (28.0, 1.0)]
    assert [r[0] for r in df.select(C.ladder("v", [(30, "low"), (50, "mid")], "high")).collect()] == ["high", "low"]
    assert one(spark, C.strip_suffix("a", ".csv"), C.basename("a"), a="x/xcsv.csv") == ("x/xcsv", "xcsv.csv")


def test_names_are_normalised_and_collisions_refused(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Tin.g` int, `rerun?` int, SpeciesID int")
    assert verbs.snake_case(df).columns == ["tin_g", "rerun", "species_id"]
    with pytest.raises(ValueError):
        verbs.snake_case(df.toDF("Notes", "notes ", "x"))


def test_filter_of_itself_keeps_null(spark, rows):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    assert rows(verbs.keep_unless(df, F.col("x") > 3)) == [(1,), (None,)]


def test_stack_needs_equal_columns(spark):
    a, b = spark.sql("select 1 a, 2 b"), spark.sql("select 3 b, 4 a")
    assert [tuple(r) for r in verbs.stack(a, b).collect()] == [(1, 2), (4, 3)]
    with pytest.raises(ValueError):
        verbs.stack(a, spark.sql("select 1 a"))


def test_relocate_and_fuzzy_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `Abs Pres, kPa` int")
    assert verbs.relocate(df, ["b"], before="a").columns == ["b", "a", "Abs Pres, kPa"]
    assert verbs.rename_matching(df, {"pressure": "Abs"}).columns == ["a", "b", "pressure"]
    with pytest.raises(ValueError):
        verbs.rename_matching(df, {"x": "nothing"})


def test_order_by_levels(spark):
    df = spark.createDataFrame([("HIGH",), ("LOW",), ("other",)], "et string")
    assert [r[0] for r in verbs.order_by_levels(df, "et", ["LOW", "HIGH"]).collect()] == ["LOW", "HIGH", "other"]
