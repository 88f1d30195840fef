"""Stage store: whole stages are found again, torn ones written anew, nothing left after close."""

import os

import pytest
from pyspark.sql import functions as F

from fieldlab.session import shared_dir
from fieldlab.sources.stages import StageStore


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("k"), F.lit(None).cast("string").alias("note")).write.parquet(path)
    return path


def chain(spark, store, source, factor=2, fail=False):
    calls = []

    def build(name, f):
        def run():
            calls.append(name)
            return f()
        return run
    a = store.stage("clean", build("clean", lambda: spark.read.parquet(source).where("id > 9")), [source])
    b = store.stage("scaled", build("scaled", lambda: a.withColumn("v", F.col("id") * factor)), ["clean"], {"factor": factor}, ["k"])
    if fail:
        raise RuntimeError("lost")
    return calls, store.stage("sums", build("sums", lambda: b.groupBy("k").agg(F.sum("v").alias("v"))), ["scaled"])


def test_a_killed_run_goes_on_behind_its_last_whole_stage(spark, source):
    with pytest.raises(RuntimeError), StageStore(spark, "killed") as store:
        chain(spark, store, source, fail=True)
    # Data without a manifest: the writer died before the stage was whole.
    torn = StageStore(spark, "killed")
    version = torn.version("clean", [source], {"by": [], "params": {}})
    torn._remove(f"{torn.base}/clean/{version}/manifest")
    with StageStore(spark, "killed") as store:
        calls, sums = chain(spark, store, source)
        assert calls == ["clean", "sums"] and store.reused == ["scaled"] and store.written == ["clean", "sums"]
        assert {r.k: r.v for r in sums.collect()} == {k: 2 * sum(i for i in range(10, 100) if i % 4 == k) for k in range(4)}
        notes = {r.stage: (r.n_rows, list(r.partitions), list(r.inputs)) for r in store.manifests().collect()}
        assert notes == {"clean": (90, [], [source]), "scaled": (90, ["k"], ["clean"]), "sums": (4, [], ["scaled"])}
        base = store.base
    assert not os.path.exists(base.removeprefix("file:"))


def test_parameters_and_files_decide_the_version(spark, source):
    with StageStore(spark, "versions", keep=True) as store:
        chain(spark, store, source)
    with StageStore(spark, "versions", keep=True) as store:
        calls, sums = chain(spark, store, source, factor=3)
        assert calls == ["scaled", "sums"] and sums.agg(F.sum("v")).first()[0] == 3 * sum(range(10, 100))
        assert all(len(store._folders(f"{store.base}/{s}")) == 1 for s in ("clean", "scaled", "sums"))
    spark.range(100, 110).select("id", F.lit(0).alias("k"), F.lit("new").alias("note")).write.mode("append").parquet(source)
    with StageStore(spark, "versions") as store:
        calls, sums = chain(spark, store, source, factor=3)
        assert calls == ["clean", "scaled", "sums"] and sums.agg(F.sum("v")).first()[0] == 3 * sum(range(10, 110))
    assert "versions" not in os.listdir(os.path.join(shared_dir(spark).removeprefix("file:"), "stages"))


def test_only_the_partitions_at_hand_are_overwritten(spark, source):
    with StageStore(spark, "patched") as store:
        chain(spark, store, source)
        before = store.version("sums", ["scaled"])
        got = store.replace_partitions("scaled", spark.range(2).select("id", F.lit(3).alias("k"), F.lit("x").alias("note"),
                                                                       F.lit(7).cast("long").alias("v")), ["k"])
        assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {0: 22, 1: 22, 2: 23, 3: 2}
        assert got.columns == ["id", "k", "note", "v"] and store.version("sums", ["scaled"]) != before
        assert {r.stage: r.n_rows for r in store.manifests().collect()}["scaled"] == 69


def test_empty_stage_and_bad_names(spark, source):
    with StageStore(spark, "empty") as store:
        none = store.stage("none", lambda: spark.read.parquet(source).where("id < 0"), [source])
        assert none.count() == 0 and none.columns == ["id", "k", "note"] and store.manifests().first().n_rows == 0
    for bad in ("", "a/b"):
        with pytest.raises(ValueError):
            StageStore(spark, bad)
