"""The stages of the pipeline, each held against a plain version on its own input."""

import os

import pytest

import brute as B
import corpus_pipeline as P

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_stages(spark):
    docs = P.table(spark, FOLDER, "documents")
    names = docs.columns
    stages = dict(P.STAGES)
    kept = P.store(stages["quality rules"](spark, docs, FOLDER), "a")
    assert kept.columns == names and kept.schema == docs.schema
    base = {r.doc_id: B.quality(r.text or "")[-1] for r in docs.collect()}
    assert not any(base[r.doc_id] for r in kept.collect()) and kept.count() > 0.5 * docs.count()
    lines = P.store(stages["line dedup"](spark, kept, FOLDER), "b")
    want = {d: sha for d, _, _, sha in B.lines([(r.doc_id, r.text) for r in kept.collect()])}
    assert {r.doc_id: B.sha(r.text) for r in lines.collect()} == want and lines.schema == docs.schema
    apart = P.store(stages["near dedup"](spark, lines, FOLDER), "c")
    left = [r.doc_id for r in apart.collect()]
    texts = [(r.doc_id, r.text) for r in lines.collect()]
    pairs = B.near_pairs(texts)
    wide, sure = B.classes(texts, pairs), B.classes(texts, [p for p, both in pairs.items() if both])
    assert len(left) == len(set(left)) and set(left) <= set(want)
    assert {d for d in want if wide[d] == d} <= set(left) <= {d for d in want if sure[d] == d}
    clean = P.store(stages["decontamination"](spark, apart, FOLDER), "d")
    items = [(r.item_id, r.text) for r in P.table(spark, FOLDER, "benchmark").collect()]
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in apart.collect() if not B.contamination(r.text, items)[-1]}
    assert {r.doc_id for r in stages["packing"](spark, clean, FOLDER).collect()} == {r.doc_id for r in clean.collect()}


def test_run_on_an_empty_table(spark, tmp_path):
    import shutil
    P.table(spark, FOLDER, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{FOLDER}/benchmark.parquet", tmp_path)
    assert P.run(spark, str(tmp_path)).count() == 0
