"""Batches and levels of the line runs, with null and outlying ids."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlab.llm import line_dedup

LAST = 2 ** 63 - 1


def plain(rows):
    first = {}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    at = lambda d: LAST if d is None else d
    for d, t in rows:
        for x in map(key, (t or "").split("\n")):
            first[x] = min(first.get(x, LAST), at(d))
    return sorted(((d, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == at(d))) for d, t in rows), key=repr)


@pytest.mark.parametrize("case", ["all null", "one outlier", "mixed", "one id", "negative"])
def test_batches_of_odd_ids(spark, case, monkeypatch):
    pick = random.Random(1)
    rows = [(i, "\n".join(f"A line that is long enough {pick.randrange(40)}" for _ in range(pick.randrange(1, 6)))) for i in range(80)]
    if case == "all null":
        rows = [(None, t) for _, t in rows]
    if case == "one id":
        rows = [(7, t) for _, t in rows]
    if case == "one outlier":
        rows.append((LAST - 1, rows[0][1] + "\n" + rows[50][1]))
    if case == "negative":
        rows = [(i - 40, t) for i, t in rows]
    if case == "mixed":
        rows = [(None if i % 3 == 0 else i, t) for i, t in rows] + [(LAST - 1, rows[3][1]), (None, None), (None, ""), (5, "x" * 70_000 + "\n" + rows[9][1])]
    seen, absorb = [], line_dedup.LineRuns.absorb
    monkeypatch.setattr(line_dedup.LineRuns, "absorb", lambda self, part: (absorb(self, part), seen.append([len(x) for x in self.levels]))[0])
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    got = line_dedup.dedup_lines(df, batches=4, fanout=2).select("doc_id", "kept_text").collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows)
    if case in ("one outlier", "mixed", "negative"):
        assert len(seen) == 4 and seen[1] == [0, 1] and seen[3] == [0, 0, 1]  # two runs make one of the next level


def test_batches_are_of_like_size(spark):
    lines = spark.range(1000).select(F.when(F.col("id") == 5, LAST - 1).when(F.col("id") % 10 == 0, LAST).otherwise(F.col("id")).alias("doc"))
    sizes = [lines.where(c).count() for c in line_dedup.id_ranges(lines, 4)]
    assert sum(sizes) == 1000 and max(sizes[:3]) < 260


def test_compaction_moves_no_rows(spark):
    runs = line_dedup.LineRuns(spark)
    parts = [runs._write(spark.range(a, a + 500).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.col("id").alias("first"))
                         .repartition(runs.buckets, "key")) for a in (0, 500)]
    merged = runs.merged(*parts)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert merged.where("first IS NOT NULL").select("key").distinct().count() == 1000
