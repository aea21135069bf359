"""Operator 3 on labels that the training didn't see."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from stridewell.llm import toxicity

from .common import no_documents, odd_documents

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    return toxicity.op3_ngram_nb_toxicity(spark, SF).join(labels, "doc_id", "left").toPandas()


def test_every_document_has_a_score(spark, scored):
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()


def test_held_out_accuracy(scored):
    part = scored[scored.held_out & scored.toxic.notna()]
    toxic = part.toxic == 1
    assert toxic.sum() >= 3 and ((part.predicted == 1) == toxic).mean() >= 0.95
    assert (part.score[toxic].to_numpy()[:, None] > part.score[~toxic].to_numpy()).mean() >= 0.95


def test_held_out_labels_are_never_used(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", (labels.toxic + toxicity.is_held_out(labels.doc_id).cast("int")) % 2)
    a, b = toxicity.train(docs, labels, rounds=3), toxicity.train(docs, turned, rounds=3)
    assert np.array_equal(a[0], b[0]) and a[1] == b[1]


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(5, 1), (6, None), (8, 0), (9, 0), (10, 0), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    assert len(out) == 14 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.id in (1, 2, 3)}) == 1
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(no_documents(spark), model).count() == 0 and toxicity.drop_toxic(no_documents(spark), model).count() == 0
    none = toxicity.train(no_documents(spark), labels)
    assert not none[0].any() and toxicity.drop_toxic(docs, none).count() == 14
    only = toxicity.train(docs, labels.filter("toxic = 0"))
    assert not only[0].any()
