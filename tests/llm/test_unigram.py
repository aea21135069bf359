"""Operator 9 against the best of all segmentations, and exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from stridewell.llm import unigram
from stridewell.llm.text import PerPiece

from .common import DATA, no_documents, odd_documents

PIECES = [("▁", -3.0), ("a", -2.0), ("b", -2.5), ("ab", -3.0), ("▁a", -2.25), ("ba", -4.0), ("▁ab", -5.0), ("bab", -5.5), ("é", -6.0), ("▁▁", -4.0)]


def best_score(text: str, model: unigram.Model) -> float:
    """Dynamic programming over characters of the text with a marker before it."""
    s = ("▁" + text.replace(" ", "▁")) if text else ""
    score = dict(zip([p for p, _ in PIECES], model.score[256:], strict=True))
    best = [0.0] + [-np.inf] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - 4), j):
            piece = s[i:j]
            if piece in score:
                best[j] = max(best[j], best[i] + score[piece])
        if s[j - 1] not in score:
            best[j] = max(best[j], best[j - 1] + model.unknown)
    return best[-1]


def encoded(model: unigram.Model, texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, n = model.encode(np.frombuffer(b"".join(raw), np.uint8), at, PerPiece(model.segment, np.uint32))
    return np.split(ids, np.cumsum(n)[:-1])


def test_segmentations_are_the_best(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aabb é z") for _ in range(rng.randrange(14))) for _ in range(400)]
    model = unigram.Model(pieces=PIECES)
    for text, ids in zip(texts, encoded(model, texts), strict=True):
        score, k = 0.0, 0
        for i in ids.tolist():
            score += model.score[i] if i >= 256 else 0.0
        unknown = sum(c not in "ab é" for c in text)
        assert score + unknown * model.unknown == best_score(text, model), text
        back, _ = model.decode(ids.astype(np.int64), np.array([len(ids)]))
        assert back.tobytes().decode() == text and k == 0


def test_trie_finds_every_piece():
    model = unigram.Model()
    text = "The ▁quick brown  fox über 東京".encode()
    data = np.frombuffer(text, np.uint8)
    start, end, piece = model.matches(data, np.full(len(data), len(data)))
    found = set(zip(start.tolist(), end.tolist(), piece.tolist(), strict=True))
    spelled = {model.piece_bytes[model.piece_at[i] : model.piece_at[i + 1]].tobytes(): i for i in np.flatnonzero(~model.is_byte).tolist()}
    want = {(a, b, spelled[text[a:b]]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in spelled}
    assert found == want


def test_documents_round_trip(spark):
    out = unigram.op9_unigram_pieces(spark, DATA).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert len(out) == len(texts) and all(r.round_trip for r in out)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    pieces = unigram.encode(docs)
    assert {r.id: r.text for r in unigram.decode(pieces).collect()} == texts
    crc = {r.id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces.collect()}
    assert {r.doc_id: r.ids_crc32 for r in out} == crc


@pytest.mark.parametrize("text", ["▁", " ▁ a", "a▁b", "  two  spaces ", "\ttab\n", "\x00 nul", "🏴󠁧󠁢󠁥󠁮󠁧󠁿", "ﬁ ligature", "é"])
def test_odd_texts_round_trip(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pieces = unigram.encode(df)
    assert pieces.first().round_trip and unigram.decode(pieces).first().text == text


def test_odd_rows(spark):
    out = unigram.round_trip(odd_documents(spark)).collect()
    assert len(out) == 14 and all(r.round_trip for r in out)
    assert [r.n_pieces for r in out if r.id in (1, 2)] == [0, 0]
    assert unigram.round_trip(no_documents(spark)).count() == 0 and unigram.encode(no_documents(spark)).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, [])], "id long, ids array<int>")
    assert sorted(r.text for r in unigram.decode(nulls).collect()) == ["", ""]
