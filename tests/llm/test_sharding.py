"""Operator 6: the table, and rows placed by it."""

from __future__ import annotations

from collections import Counter

import pytest

from stridewell.llm import sharding

from .common import DATA, no_documents, odd_documents

NAMES = [f"s{i}" for i in range(7)]


def brute(names: list[str], slots: int) -> list[int]:
    """Whole preference lists, then turn by turn."""
    orders = []
    for n in names:
        a, s = sharding._hash(f"offset {n}") % slots, sharding._hash(f"step {n}") % (slots - 1) + 1
        orders.append([(a + k * s) % slots for k in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    table = [-1] * slots
    while -1 in table:
        for i, order in enumerate(orders):
            free = [x for x in order if table[x] < 0]
            if free:
                table[free[0]] = i
    return table


def test_table_equals_brute_force():
    assert sharding.fill(NAMES, 251) == brute(NAMES, 251)


def test_slots_are_even_and_few_move():
    table = sharding.fill(NAMES, 10007)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    later = sharding.fill(NAMES[:-1], 10007)
    moved = sum(a != b for a, b in zip(table, later, strict=True) if a != 6)
    assert moved < 0.25 * 10007
    heavy = Counter(sharding.fill(NAMES, 10007, {"s0": 3}))
    assert 2.9 < heavy[0] / heavy[1] < 3.1


@pytest.mark.parametrize("names,slots,weights", [([], 7, {}), (["a", "a"], 7, {}), (["a"], 8, {}), (NAMES, 5, {}), (["a"], 7, {"a": 0})])
def test_wrong_parameters(names, slots, weights):
    with pytest.raises(ValueError):
        sharding.fill(names, slots, weights)


def test_query_places_every_document_evenly(spark):
    out = sharding.op6_slot_table(spark, DATA).toPandas()
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert len(out) == n and out.doc_id.is_unique and out.shard.between(0, 63).all()
    table = sharding.fill([f"shard-{i:03d}" for i in range(64)])
    assert [table[s] for s in out.slot] == out.shard.tolist() and (out.shard_without_last < 63).all()


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source")
    back = sharding.write_shards(docs, f"file://{tmp_path}/out", ["doc_id"], NAMES, files=2)
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in docs.collect())
    placed = sharding.place(docs, ["doc_id"], NAMES)
    assert back.groupBy("shard").count().orderBy("shard").collect() == placed.groupBy("shard").count().orderBy("shard").collect()


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumnRenamed("row", "slot")
    out = sharding.place(docs, ["doc_id"], NAMES)
    assert out.count() == 14 and out.columns == [c for c in docs.columns if c != "slot"] + ["slot", "shard"]
    assert len({r.shard for r in out.filter("doc_id = 12").collect()}) == 1
    assert sharding.place(no_documents(spark), ["doc_id"], NAMES).count() == 0
