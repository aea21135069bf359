"""Operator 7 against a count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stridewell.llm import substrings

from .common import DATA, no_documents, odd_documents, words


def brute(rows: list[tuple[int, str | None]], n: int = 35) -> dict[int, tuple[int, int, str]]:
    texts = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[k : k + n]) for _, w in texts for k in range(len(w) - n + 1))
    out = {}
    for i, w in texts:
        gone = set()
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(df) -> dict[int, tuple[int, int, str]]:
    return {r[0]: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in df.collect()}


def test_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert {r[0]: tuple(r)[1:] for r in substrings.op7_fm_index(spark, DATA).collect()} == brute(rows)


def passages(seed: int, n_rows: int = 250) -> list[tuple[int, str]]:
    rng, rows = random.Random(seed), []
    shared = [[f"p{rng.randrange(8)}" for _ in range(rng.choice([30, 34, 35, 36, 50, 90]))] for _ in range(12)]
    for i in range(n_rows):
        text: list[str] = []
        for _ in range(rng.randrange(5)):
            text += [f"u{rng.randrange(5000)}" for _ in range(rng.randrange(40))]
            passage = rng.choice(shared)
            a = rng.choice([0, 0, rng.randrange(len(passage))])
            text += passage[a:] * rng.choice([1, 1, 2])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows


@pytest.mark.parametrize("many_segments", [4_000, 3])
def test_shared_passages_equal_brute_force(spark, monkeypatch, many_segments):
    monkeypatch.setattr(substrings, "MANY_SEGMENTS", many_segments)
    rows = passages(many_segments)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(substrings.dedup_substrings(df)) == brute(rows)


def test_backward_search_counts_as_a_scan_does():
    # as in a shard: numbers from 1, a zero after each segment and at the end; patterns have no zero
    rng = np.random.default_rng(0)
    symbols = rng.integers(1, 5, 400)
    symbols[[*range(30, 400, 37), 399]] = 0
    index = substrings.FmIndex(symbols, depth=40)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        pattern = rng.integers(1, 5, n)
        low, high = np.zeros(1, np.int64), np.array([400])
        for s in pattern[::-1]:
            low, high = index.extend(np.array([s]), low, high)
        assert int((high - low)[0]) == sum((symbols[k : k + n] == pattern).all() for k in range(400 - n + 1))


def test_odd_rows(spark):
    out = substrings.dedup_substrings(odd_documents(spark)).collect()
    assert len(out) == 14
    of = {r.id: (r.n_words, r.n_removed, r.kept) for r in out}
    assert [of[i] for i in (1, 2, 3, 4)] == [(0, 0, ""), (0, 0, ""), (0, 0, ""), (1, 0, "word")]
    assert of[5][1] == of[5][0] and of[10] == (50, 50, "") and of[None][2] == "Tail."
    assert [r.n_removed for r in out if r.id == 12] == [0, 0]
    assert substrings.dedup_substrings(no_documents(spark)).count() == 0


def test_one_word_many_times(spark):
    rows = [(1, "a " * 5000), (2, "b " * 34), (3, "b " * 35), (4, "c " * 36)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(substrings.dedup_substrings(df)) == brute(rows)
