from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from stridewell.llm import prefix_tree
from stridewell.llm.registry import ORACLE_SQL

from .common import DATA, words

SCHEMA = "conv_id long, turn long, role string, text string, id string, key string, n_convs int, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "k", 7, 3) for r in rows], SCHEMA).repartition(3)


def brute(rows, every=20, heads=4):
    """Every node by its whole sequence of turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            t = (role or "", text or "")
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest(), t))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = own.get(c - c % every, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(words(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(node)))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    out = prefix_tree.prefix_tree(table(spark, rows)).drop("turn")
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_rows():
    rows = []
    for c in range(120):
        n = (c * 7) % 6
        for t in range(n):
            # few different turns, so that conversations share beginnings, end inside others and equal them
            rows.append((c, t if t else None, "user" if t % 2 == 0 else None, f"say {(c // 9 + t) % 2} {'more words ' * (t % 3)}" if (c + t) % 11 else None))
    rows += [(40 + c, t, "user", "the same") for c in range(0, 50, 3) for t in range(2)]
    return rows


@pytest.mark.parametrize("ids_at_once", [2, 1 << 14])
def test_equals_brute_force(spark, monkeypatch, ids_at_once):
    monkeypatch.setattr(prefix_tree, "IDS_AT_ONCE", ids_at_once)
    rows = some_rows()
    assert found(spark, rows) == brute(rows)


def test_many_equal_conversations_span_partitions(spark):
    rows = [(c, t, "user", f"hello {t}") for c in range(400) for t in range(4)] + [(c, 4, "user", f"own {c}") for c in range(0, 400, 50)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [(None, 1, "user", "nobody's"), (3, None, None, None), (3, None, None, None), (3, 1, "user", long), (3, 1, "user", "tie"), (23, 1, "", ""), (23, 2, "user", " \n\t "), (23, 2, "user", " \n\t "), (1, 5, "a:b", "c"), (1, 5, "a", "b:c"), (20, 0, "user", "x")]
    assert found(spark, rows) == brute(rows)


def test_a_conversation_without_turns_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "one"), (c, 1, "user", "two")]
    got = found(spark, rows)
    assert got == brute(rows) and [r[:6] for r in got] == [(c, 0, None, 1, 0, 1)]


def test_a_long_conversation(spark):
    rows = [(c, t, "user", f"turn {t} of {c if t > 700 else 0}") for c in (0, 20, 40) for t in range(900)]
    out = prefix_tree.prefix_tree(table(spark, rows)).toPandas()
    # 700 is where they part, each goes on alone; a conversation of id 0 modulo 20 lends to itself
    assert len(out) == 1 + 701 + 3 * 199 and out.n_leaves.max() == 3
    assert out[out.depth == 701].n_children.tolist() == [3] and out[out.depth == 1].n_convs.tolist() == [3]
    assert out[out.depth == 0].saved_tokens.tolist() == [2 * 4 * 701]


def test_an_empty_table_has_no_nodes(spark):
    assert found(spark, []) == []


def test_no_point_inside_an_edge_but_where_partitions_meet(spark):
    rows = [(c, t, "user", f"{c if t > 3 else 0} {t}") for c in (0, 20, 40, 60) for t in range(8)]
    tree = prefix_tree.points(prefix_tree.rebuilt(table(spark, rows)).coalesce(1)).toPandas()
    assert set(tree[~tree.depth.isin([0, 4, 8])].n_children) <= {1}
    assert sum(len(t) for t in tree["tail"]) == 1 + 4 + 4 * 4


def test_turns_lead_back_to_texts(spark):
    df = table(spark, [(0, 0, "user", "hi"), (0, 1, None, "there")])
    keys = {bytes(r.k): (r.role, r.text) for r in df.select(prefix_tree.turn_key(df.role, df.text).alias("k"), "role", "text").collect()}
    out = prefix_tree.prefix_tree(df).orderBy("depth").collect()
    assert [keys.get(bytes(r.turn)) for r in out] == [None, ("user", "hi"), (None, "there")]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{DATA}/conversations.parquet')")
    want = con.execute(ORACLE_SQL["op12_patricia"]).df()
    got = prefix_tree.op12_patricia(spark, DATA).toPandas()
    frame = lambda x: x[sorted(x.columns)].astype({"parent_conv_id": "float"}).sort_values(sorted(x.columns)).reset_index(drop=True)
    assert len(want) > 50
    pd.testing.assert_frame_equal(frame(got), frame(want), check_dtype=False)
