from __future__ import annotations

from itertools import permutations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from stridewell.llm import lattice
from stridewell.llm.registry import ORACLE_SQL

from .common import DATA, PROSE, no_documents, odd_documents, words

LABELS = "doc_id long, quality int, toxic int, n int"


def brute(docs, labels, letters="ABCDE"):
    """Each document walks each order."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        w = words(text)
        copy = i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in sorted({r[0] for r in rows}):
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys(letters, 0)
        steps = []
        for order in permutations(letters):
            for k, x in enumerate(order):
                left = [r for r in own if not any(r[1][y] for y in order[:k])]
                lost = [r for r in left if r[1][x]]
                shapley[x] += len(lost)
                alone = sum(r[1][x] and not any(r[1][y] for y in letters if y != x) for r in own)
                steps.append((part, "".join(order), k + 1, len(left) - len(lost), len(lost), sum(r[1][x] for r in own) - len(lost), alone, sum(r[2] for r in lost), sum(r[3] for r in lost), x))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


LONG = " ".join(f"w{i}" for i in range(300))
DOCS = [
    (1, PROSE, "en"), (2, PROSE, "en"), (3, PROSE, "de"), (2, PROSE, "en"), (1, PROSE, "fr"), (None, PROSE, "en"), (None, PROSE, "en"),
    (4, None, None), (5, "", ""), (6, "ALL CAPITALS # here", "en"), (7, LONG, "en"), (8, LONG, "en"), (9, LONG + " |", "de"), (10, "again " * 400, "de"),
    (11, " \n\t ", "de"), (12, "Ä ß 東京 \U0001f600", "en"), (13, LONG.upper(), "en"), (13, "another text of one id $", "en"), (-1, LONG, "es"),
]
MARKS = [(1, 1, 0, 0), (1, 1, 1, 0), (2, 0, 1, 0), (7, 1, None, 0), (8, 1, 1, 0), (None, 1, 1, 0), (10, None, 1, 0), (99, 1, 1, 0)]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(*d, 1, 2, "m") for d in DOCS], "doc_id long, text string, lang string, id int, n int, mask string").repartition(3)
    out = lattice.audit(docs, spark.createDataFrame(MARKS, LABELS))
    assert sorted(map(tuple, out.collect())) == brute(DOCS, [m[:3] for m in MARKS])


def test_odd_documents_without_labels(spark):
    df, none = odd_documents(spark), spark.createDataFrame([], LABELS)
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect()]
    assert sorted(map(tuple, lattice.audit(df, none).collect())) == brute(rows, [])
    assert lattice.audit(no_documents(spark), none).collect() == []


def test_many_copies(spark):
    docs = [(i, PROSE if i % 3 else LONG, "en" if i % 2 else "de") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    assert sorted(map(tuple, lattice.audit(df, spark.createDataFrame([(1, 1, 1, 0), (3, 1, 0, 0)], LABELS)).collect())) == brute(docs, [(1, 1, 1), (3, 1, 0)])


def test_other_filters(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a"), (4, "b")], "doc_id long, text string").withColumn("source", F.lit("web"))
    out = lattice.audit(docs, spark.createDataFrame([], LABELS), {"x": F.col("text").contains("a"), "y": F.col("text").contains("b")}, "xyE", "source")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in out.collect()}
    assert len(rows) == 18 and rows["xyE", 1] == (1, 3, 0, 1, 2 * 3 + 2 * 2 + 2 * 1) and rows["xyE", 3] == (0, 0, 1, 0, 2 * 1 + 1)
    assert rows["yEx", 3] == (0, 1, 2, 1, rows["xyE", 1][4])


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(ORACLE_SQL["op11_lattice_edges"]).df()
    got = lattice.op11_lattice_edges(spark, DATA).toPandas()
    frame = lambda x: x[sorted(x.columns)].sort_values(sorted(x.columns)).reset_index(drop=True)
    assert len(want) == 4 * 600
    pd.testing.assert_frame_equal(frame(got), frame(want), check_dtype=False)
