"""Operator 12: the prefix tree of conversations, built as a Patricia tree.

Conversations are sorted by their turns, longer ones before those that are their beginnings, by
range partitions that part equal ones too.  One pass over a sorted partition keeps the open points
of the tree on a stack and makes a point only where conversations branch, end, or run out; the turns
between two points are a compressed edge.  Counts and sums of a subtree add up along the stack, as a
subtree is a stretch of the sorted order.  A conversation creates the nodes below what it has in
common with the one before it, so a node counts once although partitions share it; the points on
the path where one partition ends and the next begins are written by both and added up by key.
Nodes inside edges come last: their counts are those of the point below, their sums add the
suffix sums of the edge.

A row holds a conversation as 24 bytes for each turn; texts don't travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import forget, shared_folder, written
from .text import read_table

#: Members whose ids go into one row, where the members of a node are hashed from several rows.
IDS_AT_ONCE = 1 << 14
#: A parent of more than one in so many points is looked up by broadcast: there are fewer than this of them.
WIDE = 1000
#: Points that a task holds before it hands them on.
_ROWS = 4096
#: Greater than any key of a turn.
_END = b"\xff" * 17
_EMPTY = hashlib.sha256(b"").hexdigest()
_TURNS = "array<struct<turn:bigint,key:binary,words:bigint>>"
_POINT = (
    "kind string, shared boolean, depth long, key binary, parent_depth long, parent_key binary, conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string, tail array<long>, turns array<binary>, part long, chunk long, ids string"
)
_FIELDS = [c.split()[0] for c in _POINT.split(", ")]


def turn_key(role: Column, text: Column) -> Column:
    """128 bits that stand for a turn; equal for equal role and text (null as empty)."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def rebuilt(df: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """conv_id, keys and words: the turns of each conversation, with a head lent by another.

    The first h turns come from conversation ``conv_id - conv_id % every``, as far as it has them, h
    being the CRC-32 of the decimal id modulo ``heads``; its own turns after the first h follow.  Turns
    are in the order of ``turn`` (null first), then of a hash of role and text.  One shuffle of
    narrow rows puts a conversation beside the one that lends to it.  Rows of a null id belong to no conversation.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")).cast("bigint")
    c = F.col("conv_id").cast("bigint")
    rows = df.filter(c.isNotNull()).select(c.alias("c"), (c - c % every).alias("b"), F.struct(F.col("turn").cast("bigint").alias("turn"), turn_key(F.col("role"), F.col("text")).alias("key"), words.alias("words")).alias("t"))
    own = rows.repartition("b").groupBy("b", "c").agg(F.sort_array(F.collect_list("t")).alias("own"))
    lent = F.max(F.when(F.col("c") == F.col("b"), F.slice("own", 1, heads))).over(Window.partitionBy("b"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).cast("int")
    all_turns = own.withColumn("lent", F.coalesce(lent, F.array().cast(_TURNS))).withColumn("h", h)
    turns = F.concat(F.slice("lent", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    return all_turns.select(F.col("c").alias("conv_id"), turns.alias("t")).select("conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


class _Point:
    """An open point of the stack: sums over the conversations below it that this task has seen."""

    __slots__ = ("depth", "created", "shared", "n", "low", "leaves", "total", "made", "children", "ids", "chunks")

    def __init__(self, depth: int, created: bool, shared: bool = False):
        self.depth, self.created, self.shared = depth, created, shared
        self.n = self.leaves = self.total = self.made = self.children = self.chunks = 0
        self.low: int | None = None
        self.ids: list[int] = []


def _common(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class _Tree:
    """The stack of one sorted partition; ``rows`` collects closed points and lists of members."""

    def __init__(self, part: int, before: list[bytes] | None):
        self.part, self.before = part, before
        self.stack: list[_Point] = []
        self.path: list[bytes] = []
        self.chain: list[bytes] = [b""]
        self.cum = [0]
        self.rows: list[tuple] = []

    def _follow(self, path: list[bytes], words: list[int], keep: int, to: int) -> None:
        """Hashes and word counts of the prefixes of ``path``, those of up to ``keep`` turns being there."""
        del self.chain[keep + 1 :], self.cum[keep + 1 :]
        for i in range(keep, to):
            self.chain.append(hashlib.md5(self.chain[i] + path[i]).digest())
            self.cum.append(self.cum[i] + words[i])

    def add(self, conv: int, path: list[bytes], words: list[int]) -> None:
        if not self.stack:
            common = 0 if self.before is None else _common(self.before, path)
            self._follow(path, words, 0, common)
            self.stack = [_Point(d, self.before is None, self.before is not None) for d in range(common + 1)]
        else:
            common = _common(self.path, path)
            self._close(common)
        self.path = path
        end = self.stack[-1]
        if len(path) > common:
            self._follow(path, words, common, len(path))
            end = _Point(len(path), True)
            end.leaves = 1  # nothing longer came before it, so nothing continues it
            self.stack.append(end)
        elif end.depth == 0 and end.created and end.n == end.children == 0:
            end.leaves = 1  # only conversations without turns
        end.n += 1
        end.low = conv if end.low is None else min(end.low, conv)
        end.total += self.cum[len(path)]
        end.ids.append(conv)
        if len(end.ids) >= IDS_AT_ONCE:
            self._members(end)

    def _members(self, x: _Point) -> None:
        """A row of the members that end at a point, for points whose members come in several rows."""
        row = dict.fromkeys(_FIELDS)
        row.update(kind="ids", key=self.chain[x.depth], part=self.part, chunk=x.chunks, ids=",".join(map(str, x.ids)))
        self.rows.append(tuple(row.values()))
        x.chunks, x.ids = x.chunks + 1, []

    def _close(self, keep: int) -> None:
        """Closes the points below depth ``keep`` of the path; makes one at that depth if it branches there."""
        while self.stack[-1].depth > keep:
            x = self.stack.pop()
            if self.stack[-1].depth < keep:
                self.stack.append(_Point(keep, True))
            self._emit(x, self.stack[-1])

    def finish(self) -> None:
        """Closes the last path turn by turn: other partitions may go on along it."""
        while self.stack:
            x = self.stack.pop()
            x.shared = True
            if x.depth and (not self.stack or self.stack[-1].depth < x.depth - 1):
                self.stack.append(_Point(x.depth - 1, True))
            self._emit(x, self.stack[-1] if self.stack else None)

    def _emit(self, x: _Point, up: _Point | None) -> None:
        d, top = x.depth, up.depth if up is not None else -1
        before = self.cum[d - 1] if d else 0
        if up is not None:
            up.n, up.leaves, up.total = up.n + x.n, up.leaves + x.leaves, up.total + x.total
            up.low = x.low if up.low is None else min(up.low, x.low)
            up.made += x.made + (self.cum[d] - self.cum[top] if x.created else 0)
            up.children += x.created
        shared = x.shared or x.chunks > 0
        if shared and x.ids:
            self._members(x)
        ends = hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest() if x.ids else _EMPTY
        saved = x.total - x.n * before - x.made - (self.cum[d] - before if x.created else 0)
        edge = range(top + 1, d + 1)
        tail = [before - (self.cum[e - 1] if e else 0) if e < d else 0 for e in edge]
        self.rows.append(("point", shared, d, self.chain[d], top, self.chain[top] if up is not None else None, x.low, x.n, x.children, x.leaves, saved, None if shared else ends, tail, [self.path[e - 1] if e else b"" for e in edge], self.part, None, None))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        kinds = [pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], _FIELDS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the members of each key, whose rows come together and in order."""
    key, digest, keys, digests = None, hashlib.sha256(), [], []
    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key is not None:
        keys.append(key)
        digests.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["ids_key", "digest"])


def points(paths: DataFrame) -> DataFrame:
    """The compressed tree of (conv_id, keys, words): a row for each point, with its edge.

    key and parent_key name points, ``tail`` and ``turns`` have an entry for each turn of the edge: the
    words from it to the turn before the point, and the turn's key.  No conversations, no points.
    """
    spark = paths.sparkSession
    order = F.concat("keys", F.array(F.lit(bytearray(_END))))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    ordered = paths.withColumn("order", order).repartitionByRange("order", "conv_id").sortWithinPartitions("order", "conv_id").checkpoint()
    # a row for each partition: the last path of it
    lasts = sorted((r.part, [bytes(k) for k in r.last[:-1]]) for r in ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.max("order").alias("last")).collect())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        earlier = [last for p, last in lasts if p < part]
        tree = _Tree(part, earlier[-1] if earlier else None)
        for batch in batches:
            for conv, path, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree.add(conv, path, words)
                if len(tree.rows) >= _ROWS:
                    yield tree.taken()
        tree.finish()
        yield tree.taken()

    made = written(ordered.select("conv_id", "keys", "words").mapInArrow(build, _POINT), "tree-points")
    ids = made.filter("kind = 'ids'").repartition("key").sortWithinPartitions("key", "part", "chunk").select("key", "ids").mapInArrow(_hashed, "ids_key binary, digest string")
    own = made.filter("kind = 'point'")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = own.filter("shared").groupBy("depth", "key", "parent_depth", "parent_key", "tail", "turns").agg(F.min("conv_id").alias("conv_id"), *sums)
    same = same.join(ids, F.col("key") == F.col("ids_key"), "left").withColumn("ends_sha256", F.coalesce("digest", F.lit(_EMPTY)))
    names = ["depth", "key", "parent_depth", "parent_key", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "tail", "turns"]
    out = written(own.filter("not shared").select(names).unionByName(same.select(names)), "tree")
    forget(made)
    return out


def nodes(tree: DataFrame) -> DataFrame:
    """Every node of a tree of points(), those inside edges too.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256 and ``turn``, the key of its last turn (turn_key; empty for the root).
    """
    most = tree.count() // WIDE
    parents = tree.select(F.col("key").alias("p_key"), F.col("conv_id").alias("p_conv"), "n_children")
    wide = parents.filter(F.col("n_children") > most).drop("n_children")
    narrow = parents.filter(F.col("n_children") <= most).drop("n_children")
    marked = tree.join(F.broadcast(wide.withColumn("p_wide", F.lit(True))), F.col("parent_key") == F.col("p_key"), "left").withColumn("p_wide", F.coalesce("p_wide", F.col("parent_key").isNull())).drop("p_key")
    found = marked.filter("p_wide").unionByName(marked.filter("not p_wide").drop("p_conv").join(narrow, F.col("parent_key") == F.col("p_key")).drop("p_key"))
    each = found.select("*", F.posexplode(F.arrays_zip("tail", "turns")).alias("pos", "e"))
    first, last = F.col("pos") == 0, F.col("pos") == F.size("tail") - 1
    return each.select(
        "conv_id",
        (F.col("parent_depth") + 1 + F.col("pos")).alias("depth"),
        F.when(first, F.col("p_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        "n_leaves",
        (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("e.tail")).alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(F.lit(_EMPTY)).alias("ends_sha256"),
        F.col("e.turns").alias("turn"),
    )


def prefix_tree(df: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """nodes() of the rebuilt conversations of (conv_id, turn, role, text).

    Null roles and texts are empty ones; of equal turn numbers the order is that of a hash of role and
    text; repeated rows are turns of their own; rows of a null conv_id are left out; other columns don't
    matter.  A conversation that is left without turns is a member of the root.  An empty table gives no rows.
    """
    return nodes(points(rebuilt(df, every, heads)))


def op12_patricia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree(read_table(spark, sf_dir, "conversations")).drop("turn")
