from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stridewell.llm import pii, spans

from .common import DATA, no_documents, odd_documents

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def fits(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    """Counts by kind and the sorted spans of the base."""
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if fits(k, m.group())]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    return tuple(sum(s[2] == k for s in found) for k in BASE), joined


TEXTS = [
    None,
    "",
    "a@b.c@d.e a@b.c_x@d.e .a@b..c x@y a@b.c. @a.b.c %+-@-.-",
    "1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.01 1.2.3 1..2.3.4 9999999999999999999999.1.1.1 é1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 411111111111111 4111  1111 1111 1111 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2 3",
    "0000 0000 0000 x 123456789012 79927398713 799273987130000 " + "4" * 40,
    "+1 (743) 555-3824 +49 30 1234567. +1234 +1+22 333 444 5 +123456789012345678 + 12 345 678 9 +1...........2345678",
    "mail+1 555 010 9999@x.org +1.2.3.4.5.6.7.8.9.0",
    "é \U0001f600 me@example.com \U0001f600\n10.0.0.1\t+44 20 7946 0958",
    "a@b.c" * 50 + " " + "1.1.1.1 " * 300,
    "x" * 5000 + "@" + "y" * 5000 + ".z " + "1" * 5000 + " " + "1-" * 5000 + "1",
]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.id: r for r in pii.find(df).collect()}


def test_base_equals_brute_force(spark):
    out = found(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        n, joined = brute(t)
        assert tuple(out[i][f"n_{k}"] for k in BASE) == n, i
        assert out[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (i, joined, out[i].spans)
        assert [s for s in out[i].spans.split(",") if s.split(":")[0] in BASE] == [s for s in joined.split(",") if s]


def test_documents_equal_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = {r.doc_id: r for r in pii.op13_weak_supervision(spark, DATA).collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        n, joined = brute(t)
        assert (out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone, out[i].base_sha256) == (*n, hashlib.sha256(joined.encode()).hexdigest())


def test_ten_thousand_spans_in_one_text(spark):
    text = "é " + " ".join(f"u{i}@mail.org 10.0.{i % 300}.1" for i in range(10_000))
    out = found(spark, [text])[0]
    n, joined = brute(text)
    assert (out.n_email, out.n_ip) == n[:2] and out.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_odd_rows(spark):
    out = pii.find(odd_documents(spark)).collect()
    assert sorted((r.id or 0) for r in out) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 12]
    assert all(r.n_added == 0 and r.spans == "" for r in out)
    assert pii.find(no_documents(spark)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = pii.op13_weak_supervision(spark, DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("values", [[], [5], list(range(1, 400)), [3, 1, 2] * 100])
def test_running(spark, values):
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    sums, tops = df.select(spans.running(F.col("v"), spans.plus), spans.running(F.col("v"), spans.later)).first()
    assert sums == [sum(values[:i]) for i in range(len(values))]
    assert tops == [max(values[:i], default=0) for i in range(len(values))]


def plain_likelihoods(counts, rounds=pii.ROUNDS):
    """The same estimate with dicts: {(kind, votes): q} from {(kind, votes): n}."""
    out = {}
    prior = {True: {-1: 0.5, 0: 4.0, 1: 2.0}, False: {-1: 2.0, 0: 4.0, 1: 0.5}}
    for kind in {k for k, _ in counts}:
        p = {v: n for (k, v), n in counts.items() if k == kind}
        q = {v: 1 / (1 + math.exp(0.5 - 1.5 * sum(v))) for v in p}
        for _ in range(rounds):
            odds = math.log((sum(p[v] * q[v] for v in p) + 1) / (sum(p[v] * (1 - q[v]) for v in p) + 2))
            side = {}
            for true in (True, False):
                w = {v: p[v] * (q[v] if true else 1 - q[v]) for v in p}
                for j in range(len(pii.LABELERS)):
                    e = {x: prior[true][x] + sum(w[v] for v in p if v[j] == x) for x in (-1, 0, 1)}
                    side |= {(true, j, x): math.log(e[x] / sum(e.values())) for x in e}
            q = {v: 1 / (1 + math.exp(-(odds + sum(side[True, j, x] - side[False, j, x] for j, x in enumerate(v))))) for v in p}
        out |= {(kind, v): x for v, x in q.items()}
    return out


def test_likelihoods_and_model_equal_plain_ones(spark):
    rows, seed = [], 7
    for i in range(400):
        seed = seed * 1103515245 + 12345 & 0x7FFFFFFF
        votes = tuple((seed >> (3 * j + 4)) % 3 - 1 if (seed >> 20) % 2 else int((seed >> j) % 5 == 0) for j in range(7))
        rows.append((i % 3, votes, (seed % 4, seed % 3, 0, 1, 1, 0, 2), 1 + seed % 9))
    counts = spark.createDataFrame(rows, "kind int, votes array<int>, looks array<int>, n long").groupBy("kind", "votes", "looks").agg(F.sum("n").alias("n"))
    totals, full = defaultdict(int), defaultdict(int)
    for k, v, x, n in rows:
        totals[k, v] += n
        full[k, v, x] += n
    likely = pii.likelihoods(counts)
    got, want = {(r.kind, tuple(r.votes)): r.q for r in likely.collect()}, plain_likelihoods(totals)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

    t, f = defaultdict(float), defaultdict(float)
    for (k, v, x), n in full.items():
        for key in [f"{k}", *(f"{k}/{i}/{y}" for i, y in enumerate(x)), *(f"{k}/{20 + i}/{y}" for i, y in enumerate(v))]:
            t[key] += n * want[k, v]
            f[key] += n * (1 - want[k, v])
    model = pii.span_model(counts, likely).first().model
    assert model.keys() == t.keys()
    for key in t:
        k = key.split("/")[0]
        odds = math.log((t[k] + 1) / (f[k] + 2)) if "/" not in key else math.log((t[key] + 0.5) / (t[k] + 4)) - math.log((f[key] + 0.5) / (f[k] + 4))
        assert abs(model[key] - odds) < 1e-9


FILLER = "the quiet harbour lay under low cloud and nobody spoke of it again that evening while the ferry waited"


def planted(i):
    """A text with personal data of a kind, and that data; every third kind of text has none but looks like it."""
    given, family = pii.GIVEN[i * 7 % len(pii.GIVEN)], ["Smith", "Moreau", "Keller", "Ortega", "Novak"][i % 5]
    kinds = [
        (f"My name is {given} {family} and i wrote this", f"{given} {family}", "name"),
        (f"please call me, phone ({200 + i % 700}) 555-{1000 + i} before noon", f"({200 + i % 700}) 555-{1000 + i}", "local_phone"),
        (f"her social security number, ssn {100 + i % 500}-45-{1000 + i}, was on file", f"{100 + i % 500}-45-{1000 + i}", "identity"),
        (f"he was born {1 + i % 28}.{1 + i % 12}.19{50 + i % 40} in the north", f"{1 + i % 28}.{1 + i % 12}.19{50 + i % 40}", "birth_date"),
        (f"see order number {100 + i % 500}-99-{1000 + i} of the catalogue", None, None),
        ("we took the Harbour Line. Every Morning it left on time", None, None),
        (f"see section {100 + i % 700} 555 {1000 + i} in the manual", None, None),
    ]
    return kinds[i % len(kinds)]


def test_planted_data_is_found_and_what_looks_like_it_left_alone(spark):
    cases = [planted(i) for i in range(210)]
    texts = [f"{FILLER} {c[0]} {FILLER}." for c in cases]
    out = found(spark, texts)
    hits = wrong = 0
    for i, (_, data, kind) in enumerate(cases):
        got = [s.split(":") for s in out[i].spans.split(",") if s and s.split(":")[0] in pii.ADDED]
        here = [(k, texts[i][int(a) : int(b)]) for k, a, b in got]
        hits += data is not None and (kind, data) in here
        wrong += any(h != (kind, data) for h in here)
    n = sum(c[1] is not None for c in cases)
    assert hits >= 0.9 * n and wrong <= 0.02 * len(cases), (hits, n, wrong)
