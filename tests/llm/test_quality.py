"""Operator 8 against plain counts and the tokenizers themselves."""

from __future__ import annotations

import base64
from collections import Counter
from math import log2

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from stridewell.llm import quality

from .common import DATA, no_documents, odd_documents, words


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = words(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in lines
            lines.add(line)
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_base_counts_equal_brute_force(spark):
    out = quality.op8_token_fertility(spark, DATA)
    rows = {r.doc_id: r for r in out.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
        assert not (r.kept and r.base_failed)


def test_measures_equal_the_tokenizers(spark):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40).collect()
    out = {r.id: r for r in quality.measure(spark.createDataFrame(docs)).collect()}
    for d in docs:
        w, r = words(d.text), out[d.doc_id]
        ids = [i for x in w for i in bpe.encode_ordinary(" " + x)]
        sub = [p for x in w for p in pieces.encode(x)]
        assert r.n_tokens == len(ids)
        assert r.chars_per_token == pytest.approx(sum(map(len, w)) / max(len(ids), 1))
        assert r.byte_share == pytest.approx(sum(map(pieces.IsByte, sub)) / max(len(sub), 1))
        assert r.token_entropy == pytest.approx(-sum(c / len(ids) * log2(c / len(ids)) for c in Counter(ids).values()), abs=1e-9)


def test_bands(spark):
    good = "The council met on Tuesday to discuss the repair of the harbour wall, which storms had damaged twice in one year, and agreed to ask three builders for their plans before the summer."
    rows = [(1, good, "en"), (2, good, None), (3, good, "xx"), (4, " ".join("zqxjkvbw"[i % 8] + "qzx!~^"[i % 6] for i in range(400)), "en"), (5, "ᚠᚢᚦᚨᚱᚲ " * 30, "en")]
    out = {r.id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert out == {1: True, 2: True, 3: True, 4: False, 5: False}


def test_odd_rows(spark):
    out = quality.quality(odd_documents(spark)).collect()
    assert len(out) == 14
    of = {r.id: r for r in out}
    assert {(of[i].n_words, of[i].n_tokens, of[i].token_entropy, of[i].base_failed, of[i].kept) for i in (1, 2, 3)} == {(0, 0, 0.0, True, False)}
    assert of[5].kept and of[None].kept and of[10].base_failed and of[11].n_dup_lines == 1
    assert quality.quality(no_documents(spark)).count() == 0
