"""The pipeline: each stage acts on all that its predecessor kept."""

from __future__ import annotations

import pytest

import corpus_pipeline
from stridewell.llm import decontaminate, jaccard, secrets, toxicity
from stridewell.shared import written

from .common import DATA, no_documents, odd_documents


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [("documents", docs)]
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, DATA), f"test-{name}")
        out.append((name, docs))
    return out


def ids(df) -> set:
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay_until_the_last_stage(stages):
    columns = stages[0][1].columns
    assert all(df.columns == columns for _, df in stages[:-1])
    assert stages[-1][1].columns == ["doc_id", "ids", "n_pieces", "round_trip"]


def test_each_decision_takes_effect(spark, stages):
    (_, docs), (_, mild), (_, single), (_, clean), (_, masked), (_, pieces) = stages
    labels, benchmark = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert ids(mild) == {r.id for r in scores if r.score < 0.5} and 0 < len(ids(docs)) - len(ids(mild))
    groups = jaccard.jaccard_components(mild, words=5, percent=80).collect()
    assert ids(single) == {r.id for r in groups if r.id == r.component_id} and len(groups) > len(ids(single))
    hit = {r.id for r in decontaminate.contamination(single, benchmark).collect()}
    assert hit and ids(clean) == ids(single) - hit
    assert ids(masked) == ids(clean) == ids(pieces)
    left = secrets.scan(masked).agg({"n_access": "sum", "n_assign": "sum", "n_hex": "sum"}).first()
    assert all(n == 0 for n in left)
    assert all(r.n_chars == len(r.text) for r in masked.collect()) and all(r.round_trip for r in pieces.collect())


def test_run_gives_the_rows_of_the_stages(spark, stages):
    key = lambda r: r.doc_id
    assert sorted(corpus_pipeline.run(spark, DATA).collect(), key=key) == sorted(stages[-1][1].collect(), key=key)


@pytest.mark.parametrize("make", [odd_documents, no_documents])
def test_odd_rows_in_every_stage(spark, make):
    docs = make(spark)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, DATA)
        n = out.count()
        assert n <= docs.count() and (name not in ("secret_scans", "sentencepiece") or n == docs.count())
        assert name == "sentencepiece" or out.columns == docs.columns


def test_odd_rows_that_each_stage_keeps(spark):
    docs, stages = odd_documents(spark), dict(corpus_pipeline.STAGES)
    order = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    every = order(docs.collect())
    assert order(stages["toxicity"](spark, docs, DATA).collect()) == every
    single = stages["ngram_jaccard_join"](spark, docs, DATA)
    assert order(single.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12)] + [(True, 0)]
    assert order(stages["benchmark_decontamination"](spark, docs, DATA).collect()) == every
    assert order(stages["secret_scans"](spark, docs, DATA).collect()) == every
    assert order(stages["sentencepiece"](spark, docs, DATA).collect()) == every
