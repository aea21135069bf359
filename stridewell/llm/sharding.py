"""Operator 6: sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size: an offset and a step, both from hashes of its name, walk through all
slots.  The shards take turns claiming the next free slot of their order (a
shard of weight w claims w slots a turn), until the table is full.  A row goes
to the shard in the slot of its key's hash.

The table has as many rows as the prime, whatever the data, and is broadcast:
placement is one hash and one lookup, without a shuffle.  When a shard goes,
its slots are shared out and few others change hands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import read_table

#: Slots of the table; a prime, a thousand times the shards.
SLOTS = 65537
SHARDS = 64
#: Largest table that is broadcast (16 MB).
MOST_SLOTS = 1 << 20


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill(shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None) -> list[int]:
    """The index of the shard in each slot.

    Raises ValueError for no shards, repeated names, more shards than slots, a weight below 1
    or a number of slots that isn't prime.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be named once each and be no more than the slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    turns = [(weights or {}).get(s, 1) for s in shards]
    if min(turns) < 1:
        raise ValueError("weights must be 1 or more")
    at = [_hash(f"offset {s}") % slots for s in shards]
    step = [_hash(f"step {s}") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % slots
                table[at[i]] = i
                free -= 1
                if not free:
                    return table


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str], slots: int = SLOTS, weights: Mapping[str, int] | None = None, into: str = "shard") -> DataFrame:
    """``df`` with a column ``into``: the index of each row's shard, and ``slot``.

    Rows with equal keys share a shard, so repeated rows and ties stay together; a null key is a
    key of its own.  An existing column named ``into`` or ``slot`` is replaced.  To spread one hot
    key, add a column to ``keys`` that tells its rows apart.
    """
    if slots > MOST_SLOTS:
        raise ValueError(f"a table of more than {MOST_SLOTS} slots is not broadcast")
    spark = df.sparkSession
    table = fill(shards, slots, weights)
    lookup = spark.createDataFrame(list(enumerate(table)), f"slot int, `{into}` int")
    base = df.drop(into, "slot")
    hashed = base.withColumn("slot", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int"))
    return hashed.join(F.broadcast(lookup), "slot").select(*base.columns, "slot", into)


def write_shards(df: DataFrame, folder: str, keys: Sequence[str], shards: Sequence[str], files: int = 1, **table: object) -> DataFrame:
    """Place rows and write them under folder/shard=N, ``files`` files each; returns the written table.

    Rows are dealt by shard and a hash of the keys, so that ``files`` splits a large shard evenly.
    """
    placed = place(df, keys, shards, **table)
    salt = F.pmod(F.xxhash64(F.lit("file"), *[F.col(k) for k in keys]), F.lit(files))
    placed.repartition(len(shards) * files, "shard", salt).write.mode("overwrite").partitionBy("shard").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def op6_slot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot and shard, and its shard after the last shard has gone."""
    shards = [f"shard-{i:03d}" for i in range(SHARDS)]
    now = place(read_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], shards)
    later = place(now.withColumnRenamed("slot", "s"), ["doc_id"], shards[:-1], into="shard_without_last")
    return later.drop("s")
