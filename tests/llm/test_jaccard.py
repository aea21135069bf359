"""Operator 1 against all pairs of sets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stridewell.llm import jaccard

from .common import DATA, no_documents, odd_documents, words

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, n: int = 4) -> frozenset:
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple[int, str | None]], n: int = 4, percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in sets}


def got(df) -> dict[int, tuple[int, int]]:
    return {r[0]: (r[1], r[2]) for r in df.collect()}


def test_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert got(jaccard.op1_blocked_product(spark, DATA)) == brute(rows)


@pytest.mark.parametrize("seed,n_words,percent", [(0, 4, 85), (1, 5, 80), (2, 2, 60)])
def test_edited_copies_equal_brute_force(spark, seed, n_words, percent):
    rng, rows = random.Random(seed), []
    while len(rows) < 900:
        n = rng.choice([3, 4, 5, 7, 9, 11, 14, 18, 23, 30, 60])
        text = [rng.choice("abcdefghijkl") + str(rng.randrange(40)) for _ in range(n)]
        for _ in range(rng.randrange(1, 9)):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.choice([0, -1, rng.randrange(len(copy))])] = f"new{rng.randrange(3)}"
            rows.append((len(rows), " ".join(copy + [f"end{k}" for k in range(rng.choice([0, 0, 0, 1, 2]))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard.jaccard_components(df, words=n_words, percent=percent)) == brute(rows, n_words, percent)


def test_a_group_whose_members_meet_only_through_others(spark):
    # a drifting text: neighbours link, ends don't
    base = [f"t{i}" for i in range(220)]
    rows = [(k, " ".join(base[2 * k : 2 * k + 120])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = got(jaccard.jaccard_components(df))
    assert out == brute(rows) and {c for _, c in out.values()} == {0}


def test_blocks_of_a_linked_pair_agree_wherever_a_set_gives_them():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(2, 80))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        d = 2 * len(a) * 15 // 185 // 2
        b = np.unique(np.concatenate([a[d:], rng.integers(0, 2**63, d).astype(np.uint64)]))
        if not jaccard.linked(a, b):
            continue
        text, key, given = jaccard.shared_blocks(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        met = 0
        for parity in (0, 1):
            of = [{(int(k), int(g)) for t, k, g in zip(text, key, given, strict=True) if t == side and int(k) & 1 == parity} for side in (0, 1)]
            if of[0] and of[1]:
                shared = {k for k, _ in of[0]} & {k for k, _ in of[1]}
                needed = min(g for side in of for _, g in side) - (len(a) + len(b)) * 15 // 185
                met += len(shared) >= max(needed, 1)
        assert met


def test_odd_rows(spark):
    out = jaccard.jaccard_components(odd_documents(spark)).collect()
    assert len(out) == 14
    of = {r.id: (r.n_shingles, r.component_id) for r in out}
    assert [of[i] for i in (1, 2, 3, 4)] == [(0, 1), (0, 2), (0, 3), (1, 4)]
    assert of[5][1] == of[6][1] == of[7][1] == 5 and of[None][1] is None
    assert [r.component_id for r in out if r.id == 12] == [12, 12]
    assert jaccard.jaccard_components(no_documents(spark)).count() == 0


def test_keep_one_leaves_whole_rows(spark):
    docs = odd_documents(spark)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12)] + [(True, 0)]


def test_overlaps_add_up_block_of_columns_by_block(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    for _ in range(200):
        own = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 60)), np.uint64))
        rows = []
        for _ in range(int(rng.integers(1, 9))):
            keep = own[rng.random(len(own)) < rng.choice([0.2, 0.9, 1.0])]
            rows.append(np.unique(np.concatenate([keep, rng.integers(0, 2**64, int(rng.integers(1, 6)), np.uint64)])))
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        plain = [len(np.intersect1d(own, r)) for r in rows]
        want = [x if 100 * x >= 85 * (len(own) + len(r) - x) else -1 for x, r in zip(plain, rows, strict=True)]
        assert jaccard.overlaps(own, np.concatenate(rows), at).tolist() == want


def test_links_carry_the_accumulated_overlap(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("key"))
    rows, links, _ = jaccard.matched_rows(docs, 4, 85)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    of = {r.row: shingles(text[r.id]) for r in rows.collect()}
    found = links.collect()
    assert found and all(r.overlap == len(of[r.a] & of[r.b]) for r in found)


@pytest.mark.parametrize("common,tile", [(2, 1), (3, 2), (8, 5)])
def test_common_blocks_and_tiles_change_no_row(spark, monkeypatch, common, tile):
    # driver and tasks share no module state, so the size of a group is set where it is read
    rng, rows = random.Random(common), []
    base = [f"b{i}" for i in range(60)]
    for k in range(120):
        text = list(base) if k % 2 else [f"c{k % 7}{i}" for i in range(40)] + base[:20]
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(9)}"
        rows.append((k, " ".join(text)))
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "TILE", tile)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(jaccard.jaccard_components(df)) == brute(rows)


def test_groups_come_whole_or_as_common(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "COMMON", 4)
    rng = random.Random(3)
    for _ in range(100):
        sizes = [rng.choice([1, 1, 2, 3, 4, 5, 9, 20]) for _ in range(rng.randrange(1, 12))]
        rows = [(g, i) for g, n in enumerate(sizes) for i in range(n)]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(5))})
        parts = (pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a:b]], pa.int64()), pa.array([r[1] for r in rows[a:b]], pa.int64())], ["g", "i"]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        out = [(int(g), int(i), int(n)) for cols, size in jaccard._groups(parts, 2, 1) for g, i, n in zip(*cols, size, strict=True)]
        assert out == [(g, i, min(sizes[g], 4)) for g, i in rows]


def test_keep_one_judges_rows_not_ids(spark):
    from .common import PROSE

    other = "Quite another text that shares no words at all with those before it and stands alone here."
    rows = [(7, PROSE, "a"), (7, other, "b"), (3, PROSE + " More.", "c"), (None, PROSE, "d"), (9, other, "e"), (9, other, "f"), (10, None, "g"), (10, "", "h"), (11, "", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(4)
    for _ in range(2):
        kept = {r.id for r in jaccard.keep_one(docs).collect()}
        assert {"b", "c", "d", "i"} <= kept and not kept & {"a", "e", "f"} and len(kept & {"g", "h"}) == 1 and len(kept) == 5
