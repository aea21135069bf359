"""Operator 10: planted items, both ways of joining, and a plain version of the rules."""

from __future__ import annotations

import random
import re

import numpy as np

from stridewell.llm import decontaminate as d

from .common import DATA, PROSE, no_documents, odd_documents, words

ITEM = "A train leaves Berlin at 9 and travels 120 miles in 3 hours; how many miles does the train travel in 5 hours if it keeps its speed?"


def canonical(text: str) -> tuple[list[str], list[str]]:
    """(template, values) of a text, token by token."""
    tokens, begins, last = [], True, 0
    for m in re.finditer("[^\\x20\\x09-\\x0D]+", text):
        w = m[0]
        starts = begins or "\n" in text[last : m.start()]
        begins, last = w[-1] in ".!?:", m.end()
        core = re.sub("^[^0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\x80-\U0010ffff]+$", "", w)
        if core:
            tokens.append((core, starts, bool(re.match("[A-ZÀ-ÖØ-Þ]", core))))
    template, values = [], []
    for k, (core, starts, capital) in enumerate(tokens):
        a = b = k
        while a > 0 and tokens[a - 1][2]:
            a -= 1
        while b + 1 < len(tokens) and tokens[b + 1][2]:
            b += 1
        low = re.sub("[A-ZÀ-ÖØ-Þ]", lambda c: c[0].lower(), core)
        if re.search("[0-9]", core):
            kind = "<number>"
        elif low in d.UNITS:
            kind = "<unit>"
        elif capital and not starts and b - a + 1 < d.SHOUTED:
            kind = "<name>"
        else:
            kind = low
        template.append(kind)
        values.append(low)
    return template, values


def brute(docs: list[tuple[int, str]], items: list[tuple[int, str]]) -> set[tuple]:
    out = set()
    for item_id, text in items:
        template, values = canonical(text)
        n = min(len(template), d.WINDOW)
        if n < d.MIN_FIXED:
            continue
        led = ["<name>", *template[1:]] if not template[0].startswith("<") else template
        wins: dict[int, set] = {}
        for t in (template, led):
            for k in range(len(t) - n + 1):
                w = tuple(t[k : k + n])
                if sum(not x.startswith("<") for x in w) >= min(d.MIN_FIXED, n):
                    wins.setdefault(k, set()).add(w)
        for doc_id, body in docs:
            there, mine = canonical(body)
            diagonals: dict[int, list] = {}
            for p in range(len(there) - n + 1):
                w = tuple(there[p : p + n])
                for k, of in wins.items():
                    if w in of:
                        diagonals.setdefault(p - k, []).append(p)
            met, run = set(), 0
            for shift, ps in diagonals.items():
                covered = sorted({p + k for p in ps for k in range(n)})
                slots = [(mine[c], values[c - shift]) for c in covered if there[c].startswith("<")]
                if len(set(slots)) != len({a for a, _ in slots}) or len(set(slots)) != len({b for _, b in slots}):
                    continue
                longest = now = 0
                for k, c in enumerate(covered):
                    now = now + 1 if k and c == covered[k - 1] + 1 else 1
                    longest = max(longest, now)
                met |= {p - shift for p in ps}
                run = max(run, longest)
            if met and (len(met) / len(wins) >= d.COVERAGE or run >= d.RUN):
                out.add((doc_id, item_id, len(met), len(wins), run))
    return out


def got(df) -> set[tuple]:
    return {(r[0], r[1], r[2], r[3], r[5]) for r in df.collect()}


def test_documents_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    out = got(d.op10_template_windows(spark, DATA))
    assert out and out == brute(docs, items)


def planted(spark):
    rng = random.Random(5)
    lead = lambda: " ".join(rng.choice(words(PROSE)).lower().strip(".,") for _ in range(40))
    items = [(1, ITEM), (2, "Too short"), (3, "What is the name of the tall bird that stands on one leg?"), (4, None), (None, ITEM)]
    docs = [
        (1, f"{lead()}. {ITEM} {lead()}"),
        (2, f"{lead()}. A train leaves Madrid at 7 and travels 450 miles in 4 hours; how many miles does the train travel in 6 hours if it keeps its speed?"),
        (3, f"{lead()}. A train leaves Madrid at 7 and travels 450 km in 4 hours; how many miles does the train travel in 6 hours if it keeps its speed?"),
        (4, lead()),
        (5, "we ask: what is the name of the tall bird that stands on one leg?"),
        (6, "The train was late and the bird stood on one leg. Too short."),
        (7, f"{lead()}. WHAT IS THE NAME OF THE TALL BIRD THAT STANDS ON ONE LEG? {lead()}"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_changed_values_are_caught_if_consistent(spark):
    docs, items = planted(spark)
    out = {(r.id, r.item_id): r for r in d.contamination(docs, items).collect()}
    assert {(1, 1), (2, 1), (5, 3), (7, 3)} <= set(out) and not any(i in (4, 6) for i, _ in out)
    assert out[1, 1].n_changed_slots == 0 and out[2, 1].n_changed_slots >= 4
    # "miles" became "km" in one place only: the whole diagonal is inconsistent
    assert (3, 1) not in out
    kept = d.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 6] and kept.columns == docs.columns


def found(docs: list[str], items: list[str]) -> set[tuple[int, int]]:
    """(document, item) by position."""
    raw = [t.encode() for t in docs]
    at = np.cumsum([0, *map(len, raw)])
    return {(h[0], h[1]) for h in d.Templates(range(len(items)), items).hits(np.frombuffer(b"".join(raw), np.uint8), at)}


def test_a_break_in_one_slot_leaves_the_rest():
    item = "My sister buys 3 apples and 5 pears at the market; how many pieces of fruit does she carry home in her basket?"
    docs = [
        ITEM,
        ITEM.replace("120 miles", "120 km"),  # copied but for one of two equal values
        item.replace("3 apples", "4 apples").replace("5 pears", "4 pears"),  # two values get the same one
    ]
    assert found(docs, [ITEM, item]) == {(0, 0), (1, 0), (2, 1)}


def test_dense_items_and_copies_in_other_capitals():
    items = ["What is 37 + 48?", "Compute 12 * 7 + 5 * 9 - 3 * 8.", "Yesterday Alice gave Bob two apples and Carol three pears before Dave went home"]
    lead = "It was said over and over in the old village. "
    docs = [lead + items[0], lead + items[1], lead + items[2], lead + items[2].lower(), lead + items[2].upper(), lead + "What is 12 + 5?", lead + items[2].replace("Alice", "Zoe").replace("apples", "plums")]
    assert found(docs, items) == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 2)}


def test_plain_windows_leave_the_share_of_templates():
    item = "In the 3 long lists we count 12 7 5 9 31 8 44 6 52 17 23 91 4 60 75 2"
    other = "In the 4 long lists we count 13 1 2 3 4 5 6 7 8 9 10 11 14 15 16 18"
    assert found([other], [item]) == {(0, 0)}


def test_joining_by_shuffle_gives_the_same(spark):
    docs, items = planted(spark)
    assert got(d.contamination(docs, items, broadcast_bytes=0)) == got(d.contamination(docs, items))
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    assert got(d.contamination(docs, items, broadcast_bytes=0)) == got(d.contamination(docs, items))


def test_join_keeps_null_ids_and_repeats_with_hot_windows(spark, monkeypatch):
    monkeypatch.setattr(d, "HOT", 5)
    stock = "Which of the following is the right answer to this question about"
    names = [w * 3 for w in "abcdefghijklmnopqrstuvwxyz"]
    items = spark.createDataFrame([(i, f"{stock} {' '.join(names[(i + k * 5) % 26] + names[k] for k in range(25))}") for i in range(26)], "item_id long, text string")
    texts = {r.item_id: r.text for r in items.collect()}
    docs = spark.createDataFrame([(None, texts[3]), (None, texts[3]), (7, texts[4]), (7, texts[4]), (8, f"{stock} nothing"), (9, f"{texts[5]} {texts[6].upper()}")], "doc_id long, text string")
    out = [sorted(map(str, d.contamination(docs, items, broadcast_bytes=b).collect())) for b in (0, d.BROADCAST_BYTES)]
    assert out[0] == out[1] and len(out[0]) == 6


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (2, ""), (3, None), (None, PROSE)], "item_id long, text string")
    out = d.contamination(docs, items).collect()
    assert sorted((r.id is None, r.id or 0, r.item_id) for r in out) == [(False, 5, 1), (False, 6, 1), (False, 7, 1), (True, 0, 1)]
    # each row by its own text: that of a null id goes too
    for limit in (0, d.BROADCAST_BYTES):
        assert sorted(map(str, d.contamination(docs, items, broadcast_bytes=limit).collect())) == sorted(map(str, out))
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 8, 9, 10, 11, 12, 12]
    both = spark.createDataFrame([(5, PROSE, "a"), (5, "A clean text.", "b"), (6, "A clean text.", "c"), (None, "Another one.", "d")], "doc_id long, text string, id string")
    assert {r.id for r in d.drop_contaminated(both, items).collect()} == {"b", "c", "d"}
    assert d.contamination(no_documents(spark), items).count() == 0
    assert d.contamination(docs, items.filter("false")).count() == 0
    assert d.contamination(docs, items.filter("false"), broadcast_bytes=-1).count() == 0
