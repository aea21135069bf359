"""Operator 3 against a plain version with dicts, and the store of words against itself."""

from __future__ import annotations

import zlib
from collections import Counter
from math import exp, log, sqrt

import numpy as np
import pytest

from stridewell.llm import text, toxicity

from .common import DATA, words

ROUNDS = 12
LIMIT = 1 << 64


def mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % LIMIT
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % LIMIT
    return x ^ (x >> 31)


def grams(word: str) -> list[int]:
    marked, out = f"\x02{word.lower()}\x03", []
    for n in toxicity.SIZES:
        for i in range(len(marked) - n + 1):
            h = n
            for c in marked[i : i + n]:
                h = mixed((h * 0x100000001B3 + ord(c)) % LIMIT)
            out.append(h >> (64 - toxicity.BITS))
    return out


def features(document: str) -> Counter:
    return Counter(g for w in set(words(document)) for g in grams(w))


def plain_fit(rows: list[tuple[Counter, int]]) -> tuple[dict[int, float], float]:
    """Scaled weight of each n-gram, and the bias."""
    n, toxic = len(rows), sum(y for _, y in rows)
    bias = log((toxic + 1) / (n - toxic + 1))
    p, q = Counter(), Counter()
    for f, y in rows:
        (p if y else q).update(f)
    all_p, all_q = ((1 << toxicity.BITS) + c.total() for c in (p, q))
    ratio = {g: log((1 + p[g]) / all_p) - log((1 + q[g]) / all_q) for g in {*p, *q}}
    w, m1, m2 = (dict.fromkeys(ratio, 0.0) for _ in range(3))
    b1 = b2 = 0.0
    for t in range(1, ROUNDS + 1):
        grad, whole = dict.fromkeys(ratio, 0.0), 0.0
        for f, y in rows:
            error = (1 / (1 + exp(-bias - sum(w[g] * ratio[g] * c for g, c in f.items()))) - y) / n
            whole += error
            for g, c in f.items():
                grad[g] += ratio[g] * c * error
        step = 0.05 * sqrt(1 - 0.99**t) / (1 - 0.9**t)
        for g in ratio:
            d = grad[g] + toxicity.L2 * w[g]
            m1[g], m2[g] = 0.9 * m1[g] + 0.1 * d, 0.99 * m2[g] + 0.01 * d * d
            w[g] -= step * m1[g] / (sqrt(m2[g]) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * whole, 0.99 * b2 + 0.01 * whole**2
        bias -= step * b1 / (sqrt(b2) + 1e-8)
    return {g: w[g] * ratio[g] for g in ratio}, bias


def test_scores_equal_the_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("length(text) < 1500").orderBy("doc_id").limit(40)
    rows = docs.collect()
    labels = spark.createDataFrame([(r.doc_id, int(i % 3 == 0)) for i, r in enumerate(rows)], "doc_id long, toxic int")
    taught = [(features(r.text), int(i % 3 == 0)) for i, r in enumerate(rows) if zlib.crc32(str(r.doc_id).encode()) % 5]
    weight, bias = plain_fit(taught)
    model = toxicity.train(docs, labels, rounds=ROUNDS)
    assert set(np.flatnonzero(model[0])) <= set(weight)
    scores = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(taught) >= 20 and len(scores) == len({r.doc_id for r in rows})
    for r in rows:
        z = bias + sum(weight.get(g, 0.0) * c for g, c in features(r.text).items())
        assert scores[r.doc_id] == pytest.approx(1 / (1 + exp(-max(-40.0, min(40.0, z)))), abs=1e-3)


def test_slices_and_new_starts_of_a_store_change_nothing(monkeypatch):
    texts = ["one two three two aaaa", "", "three four Five five é日本 one", "one"]

    def gathered(store: text.PerPiece) -> list:
        out = []
        for t in texts * 2:
            data = np.frombuffer(t.encode(), np.uint8)
            start, end, _ = text.word_spans(data, np.array([0, len(data)]))
            values, lengths = store.gather(data, start, end)
            out.append((values.tolist(), lengths.tolist()))
        return out

    whole = gathered(text.PerPiece(toxicity.word_ngrams, np.int32))
    assert whole[0][0] == [g for w in words(texts[0]) for g in grams(w)]
    monkeypatch.setattr(text, "AT_ONCE", 2)
    assert gathered(text.PerPiece(toxicity.word_ngrams, np.int32)) == whole
    assert gathered(text.PerPiece(toxicity.word_ngrams, np.int32, most=3)) == whole
