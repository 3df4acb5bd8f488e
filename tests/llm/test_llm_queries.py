"""The operators' queries against their SQL on the smallest tables, and the pipeline's stages."""

import os

import pandas as pd
import pytest

import corpus_pipeline
from newsweave.llm import decontaminate, order_minhash, pii, toxicity
from newsweave.llm.queries import QUERIES
from newsweave.llm.shared import table
from workload.check import ROOT, compare, database

SF_DIR = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n, (_, text) in QUERIES.items() if text))
def test_query(spark, con, name):
    run, text = QUERIES[name]
    found = run(spark, SF_DIR)
    # Spark's frames make floats of integers beside nulls, so take its rows
    found = pd.DataFrame([tuple(r) for r in found.collect()], columns=found.columns, dtype=object)
    assert compare(found, con.execute(text).fetchdf()) == "ok"


@pytest.mark.parametrize("name", sorted(n for n, (_, text) in QUERIES.items() if not text))
def test_whole_table(spark, name):
    frame = QUERIES[name][0](spark, SF_DIR).toPandas()
    key = {"op4_transcripts": "conv_id", "op7_url_rules": "page_id", "op13_whitening": "vec_id"}.get(name, "doc_id")
    source = {"conv_id": "conversations", "page_id": "pages", "doc_id": "documents", "vec_id": "embeddings"}[key]
    ids = table(spark, SF_DIR, source).select(key).toPandas()[key]
    assert set(frame[key]) == set(ids)
    if key not in ("conv_id", "vec_id"):
        assert len(frame) == len(ids)


def test_pipeline_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_DIR).cache()
        rows, old = after.toPandas(), before.toPandas()
        assert list(rows.columns) == columns + (["taken"] if name == "mixing" else [])
        if name == "toxicity":
            score = toxicity.scores(before, toxicity.fit(before, table(spark, SF_DIR, "labels"))).toPandas()
            assert set(rows.doc_id) == set(score[score.toxicity < 0.5].doc_id)
        if name == "minhash_dedup":
            kept = order_minhash.near_duplicates(before).where("kept").toPandas()
            assert sorted(rows.doc_id) == sorted(kept.doc_id)
        if name == "decontamination":
            found = decontaminate.contamination(before, table(spark, SF_DIR, "benchmark")).toPandas()
            assert set(rows.doc_id) == set(found[found.spans.map(len) == 0].doc_id)
        if name == "pii":
            assert sorted(rows.doc_id) == sorted(old.doc_id)
            assert pii.personal_data(after).where("size(email) + size(card) > 0").count() == 0
            assert (rows.n_chars == rows.text.str.len()).all()
        if name == "mixing":
            assert (rows.taken > 0).all() and set(rows.doc_id) <= set(old.doc_id)
        before = after


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
