"""Scans and sinks on small files."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from fieldlab.plans import loggers, respiro
from fieldlab.sources import tables as S


def test_csv_scan_handles_mark_na_and_empty(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿SpeciesID,Tin.g,rerun?,n\nA,1.5,NA,1\nB,,yes,NA\n", encoding="utf-8")
    df = S.read_csv(spark, str(tmp_path / "t.csv"), "SpeciesID string, `Tin.g` double, `rerun?` string, n int")
    assert df.columns == ["species_id", "tin_g", "rerun", "n"]
    assert [tuple(r) for r in df.collect()] == [("A", 1.5, None, 1), ("B", None, "yes", None)]


@pytest.fixture
def probe_files(tmp_path):
    """Two nested probe files of one reading per second, with preamble and header."""
    for folder, name, slope in (("run2", "A1_CH1.csv", -0.05), ("run3", "B1_CH2.csv", 0.02)):
        d = tmp_path / folder
        d.mkdir()
        lines = ["device,x", "Date,Time,Channel,Value,Unit,Temp"]
        for i in range(400):
            t = datetime.datetime(2023, 3, 26, 11, 48) + datetime.timedelta(seconds=i)
            wobble = 0.01 * ((i * 7919) % 13 - 6)
            lines.append(f"3/26/2023,{t.hour}:{t:%M:%S},1,{200 + slope * i + wobble},umol,{28 + i / 1000}")
        (d / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_probe_tree_to_rates(spark, probe_files):
    logs = S.read_log_tree(spark, probe_files, ["date", "time", "channel", "value", "unit", "temp"], "date", "time", ["value", "temp"])
    assert logs.groupBy("file_id").count().collect() == [("A1_CH1.csv", 400), ("B1_CH2.csv", 400)] or logs.count() == 800
    t0 = datetime.datetime(2023, 3, 26, 11, 48)
    w = spark.createDataFrame([("A1_CH1.csv", t0, t0 + datetime.timedelta(seconds=379)), ("B1_CH2.csv", t0, t0 + datetime.timedelta(seconds=379)),
                               ("missing.csv", t0, t0)], "file_id string, start timestamp_ntz, stop timestamp_ntz")
    rows = logs.withColumn("tie", F.col("value"))
    got = {r.file_id: r for r in respiro.incubation_rates(rows, w, "file_id", "datetime", "tie", "value", "temp", skip=20, thin=10).collect()}
    assert set(got) == {"A1_CH1.csv", "B1_CH2.csv"}
    assert got["A1_CH1.csv"].slope == pytest.approx(-0.05, abs=2e-3) and got["B1_CH2.csv"].slope == pytest.approx(0.02, abs=2e-3)
    # Seconds 30, 40, ... 380 of the incubation are readings 29, 39, ... 379.
    assert got["A1_CH1.csv"].mean_temp == pytest.approx(28 + sum(range(29, 380, 10)) / 36 / 1000)


def test_manifest_bounds(spark, probe_files):
    logs = S.read_log_tree(spark, probe_files, ["date", "time", "channel", "value", "unit", "temp"], "date", "time", ["value"])
    t = datetime.datetime(2023, 3, 26, 11, 50)
    m = spark.createDataFrame([("A1_CH1.csv", t, False, None, None, None), ("B1_CH2.csv", t, True, t + datetime.timedelta(seconds=9), False, None)],
                              "file_id string, keep_from timestamp_ntz, from_incl boolean, keep_to timestamp_ntz, to_incl boolean, max_value double")
    n = {r.file_id: r["count"] for r in S.select_files(logs, m, value="value").groupBy("file_id").count().collect()}
    assert n == {"A1_CH1.csv": 400 - 121, "B1_CH2.csv": 9}


def test_logger_folder_and_fuzzy_header(spark, tmp_path):
    (tmp_path / "CT_323_high.csv").write_text("Date Time,High Range,Temp\n02/05/2023 00:00:00,51.2,86\nbroken,1,2\n2/5/2023 0:05:00,51.3,28.1\n")
    logs = S.read_log_tree(spark, str(tmp_path), ["stamp", "ec", "temp"], "stamp", numbers=["ec", "temp"])
    tidy = S.logger_series(logs, {"ec": "conductivity", "temp": "temperature"}, r"_(\d+)_")
    assert sorted(tuple(r)[1:] for r in tidy.collect()) == [("323", 51.2, 86.0), ("323", 51.3, 28.1)]
    other = tmp_path / "wl"
    other.mkdir()
    (other / "a.csv").write_text('Plot title\n"#","Date Time, GMT-10:00","Abs Pres, kPa","Water Level, meters"\n1,02/05/2023 00:00:00,101.1,-0.4\n')
    df = S.read_fuzzy_header(spark, str(other / "a.csv"), {"date": "Date", "pressure": "Abs", "depth": "Level"})
    assert {"date", "pressure", "depth"} <= set(df.columns)
    levels = df.filter(F.col("pressure") == "101.1").select(F.lit("2023-02-05 00:00:00").cast("timestamp_ntz").alias("t"), F.col("depth").cast("double").alias("depth"))
    assert loggers.water_levels([levels], "t", "depth", "2023-02-05 00:00:00", "2023-02-06 00:00:00").first().depth == 0.4


def test_stage_round_trip(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"))
    back = S.write_stage(df, S.stage_path(spark, "t"), ["k"])
    assert back.count() == 100 and set(back.columns) == {"id", "k"}


def test_header_maps(spark, tmp_path):
    """Three wordings and preambles in nested folders; a line like a reading above the header, quoted cells, short lines, no header."""
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.csv").write_text("\ufeff" + 'Plot title\n"#","Date Time, GMT-10:00","Low Range, uS","Temp, C"\n1,"1/2/2023 0:00:00","5,1",NA\n\n2,1/3/2023 0:00:00,6,27.5\n')
    (tmp_path / "a" / "b" / "two.csv").write_text("1/1/2023 0:00:00,9,9,9\nmore text\nTEMP (deg),range low,other,DATE\n28,7,x,1/4/2023 0:00:00\n29,8\n")
    (tmp_path / "three.csv").write_text("date,temp,range\n1/5/2023 0:00:00,30,9\n")
    (tmp_path / "none.csv").write_text("date,temp\n1/6/2023 0:00:00,30\n")
    (tmp_path / "empty.csv").write_text("")
    got = S.read_header_maps(spark, str(tmp_path), {"date": "date", "temp": "temp", "low": "range"})
    assert got.columns == ["date", "temp", "low", "file_id", "file_path"]
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == sorted([
        ("1/2/2023 0:00:00", None, "5,1", "one.csv"), ("1/3/2023 0:00:00", "27.5", "6", "one.csv"), ("1/4/2023 0:00:00", "28", "7", "two.csv"),
        (None, "29", "8", "two.csv"), ("1/5/2023 0:00:00", "30", "9", "three.csv")], key=repr)


def test_header_maps_of_files_in_several_splits(spark, tmp_path):
    lines = [f"{i},1/2/2023 0:00:00,{i * 2}" for i in range(4000)]
    for name, above in (("x.csv", ["title"]), ("y.csv", ["title", "7,8,9", "notes"])):
        (tmp_path / name).write_text("\n".join([*above, "n,date,value", *lines]) + "\n")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = S.read_header_maps(spark, str(tmp_path), {"at": "date", "v": "value"})
        assert got.rdd.getNumPartitions() > 4
        sums = {r.file_id: (r.n, r.s) for r in got.groupBy("file_id").agg(F.count("at").alias("n"), F.sum(F.col("v").cast("long")).alias("s")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sums == {"x.csv": (4000, sum(range(0, 8000, 2))), "y.csv": (4000, sum(range(0, 8000, 2)))}


def test_header_maps_cut_each_line_once(spark, tmp_path):
    """40,000 readings that hold the names too: no header is looked for by the parser, cell by cell and name by name."""
    (tmp_path / "in").mkdir()
    for f in range(2):
        (tmp_path / "in" / f"f{f}.csv").write_text("n,date,value,kind\n" + "".join(f"{i},1/2/2023 0:00:00,{i * 2},kind of value\n" for i in range(20000)))
    start = time.monotonic()
    got = S.read_header_maps(spark, str(tmp_path / "in"), {"at": "date", "v": "value", "k": "kind"})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_csv(") == 1
    r = got.agg(F.count("at").alias("n"), F.sum(F.col("v").cast("long")).alias("s"), F.max("k").alias("k")).first()
    assert (r.n, r.s, r.k) == (40000, 2 * sum(range(0, 40000, 2)), "kind of value")
    assert time.monotonic() - start < 25


@pytest.mark.parametrize("sep", [",", "\t", "|", "||"])
def test_header_maps_of_plain_and_other_lines(spark, tmp_path, sep):
    """Lines cut at separators and lines that the CSV parser gets agree on marks, quotes, missing and further cells."""
    lines = [["\ufeff", "date"], ["NA", "data", ""], ["x", "Date", "value"], ["a", "NA", "5"], ['"a"', "NA", "5"], ["a", " NA", ""], ['"a"', " NA", ""],
             ["b", '"1' + sep + '2"', "6"], ["c"], ["c", "d"], ['"c"', "d"], ["e", "f\\", "g", *["h"] * 70], ['"e"', "f\\", "g", *["h"] * 70], ["", "", ""],
             ["\ufeff", "i", "j"], ["x", "date", "value"]]
    (tmp_path / "a.csv").write_text("\n".join(sep.join(x) for x in lines) + "\n", encoding="utf-8")
    got = [tuple(r)[:2] for r in S.read_header_maps(spark, str(tmp_path), {"d": "DATE", "v": "value"}, sep).collect()]
    want = [(None, "5"), (None, "5"), (" NA", None), (" NA", None), ("1" + sep + "2", "6"), (None, None), ("d", None), ("d", None), ("f\\", "g"), ("f\\", "g"),
            (None, None), ("i", "j"), ("date", "value")]
    assert got == want
    first = S.read_header_maps(spark, str(tmp_path), {"x": "", "d": "date"}, sep).first()  # of the mark's line, only the second cell is there
    assert tuple(first)[:2] == ("data", "data")


def test_header_maps_drop_the_mark_of_every_file(spark, tmp_path):
    """Headers behind a byte-order mark, with a separator in quotes, in files that one task reads."""
    for f in range(40):
        (tmp_path / f"f{f}.csv").write_text('\ufeff"Date Time, GMT-10:00","value"\n' + f"1/2/2023,{f}\n", encoding="utf-8")
    got = S.read_header_maps(spark, str(tmp_path), {"d": "date", "v": "value"}).coalesce(1)
    assert sorted(int(r.v) for r in got.collect()) == list(range(40))
