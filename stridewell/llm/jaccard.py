"""Operator 1: n-gram Jaccard join as a blocked sparse matrix product.

Rows of the matrix are distinct sets of word n-grams (equal sets are one row),
columns are n-grams.  The overlap of two rows is the product of the matrix with
its transpose; a pair links if 100 * overlap >= percent * union.  Two bounds follow
from the sizes s and t alone, here for 85 percent: the smaller has at least 0.85 of
the larger, and at most d = floor((s + t) * 15 / 185) n-grams stand in only one.

Which tiles of the product to form: columns are dealt into more than d blocks by
hash, so a pair within the bounds is identical on all but d of the blocks that
either row gives.  So a row must share at least ``need`` of its blocks with any
partner, and, with blocks in one order for all (rarest first), one of the first
c - need + 1 of the c that it shares at all.  Only those are kept: blocks of
boilerplate, which many rows share, come last, and a row that shares too few has none.

Links are wanted for what they connect.  Rows of a block first meet one row each
(a star, linear in the block); then the members of blocks that still hold several
components meet across those, which leaves no link out.  Parity sketches (a lower
bound of the difference) drop pairs before sets travel.  For the pairs that stay the
product is formed tile by tile, one row against a block of rows: overlaps accumulate
block of columns by block, and after each the pairs whose rest can't reach the bound
are discarded.

Sizes come in intervals: blocks are cut by the largest size of an interval, and
a row joins the next interval too if a partner may be there.  A block with one
n-gram or none says little; it counts only for rows that have too few others to
be sure of sharing one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import forget, written
from .components import components
from .text import blocks, id_and_text, mix, pieces_hash, read_table, runs_hash, word_spans

#: Words of an n-gram and the least similarity in percent: of the query, and of near copies elsewhere.
WORDS, PERCENT = 4, 85
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Least ratio of the sizes in an interval, and the blocks beyond d + 1 in hundredths.
INTERVAL = 1.75
SPARE = 12
#: A block of so many rows or more counts as this many: such blocks are last in order, and dealt by salt.
COMMON = 512
SALTS = 32
#: Rows of one or two longs that are broadcast at most (ids whose sets are wanted, rows that go; some 70 bytes each): more go through a shuffle.
LOOKUP = 1_000_000
#: Rows that meet one row in one task, and rows of a block that are compared in one task.
STAR = 512
TILE = 2_048
COLUMN_BLOCKS = 4
#: Longs of the parity sketch of a set.
SKETCH = 16
_SKETCH = [f"s{k}" for k in range(SKETCH)]


@lru_cache
def size_bounds(percent: int = PERCENT, largest: int = 1 << 31) -> np.ndarray:
    """First size of each interval; a set's partners lie in its own, the one before or the one after."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * INTERVAL), -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of all texts joined, where those of each text begin)."""
    start, end, first = word_spans(data, at)
    hashes = pieces_hash(data, start, end, lower=True)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(hashes) >= words:
        inside = np.flatnonzero(text[: len(text) - words + 1] == text[words - 1 :])
        grams.append(runs_hash(hashes, words)[inside])
        owner.append(text[inside])
    n_words = np.diff(first)
    for n in range(1, words):  # the whole of a shorter text
        short = np.flatnonzero(n_words == n)
        if len(short):
            grams.append(mix(runs_hash(hashes, n)[first[short]] + np.uint64(n)))
            owner.append(short)
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(at)))


def running(values: np.ndarray) -> np.ndarray:
    """Sums modulo 2 ** 64 of the values before each, and of all."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def rows_of(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set; equal sets have equal hashes."""
    total = running(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def shared_blocks(grams: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of a block of columns with what the text has there, blocks to count on) of all blocks that may be compared.

    The lowest bit of a hash tells the two intervals of a text apart.  A pair whose sets differ in
    x n-grams shares at least as many blocks as the row with fewer to count on has, less x.
    """
    size, bounds = np.diff(at), size_bounds(percent)
    own = np.searchsorted(bounds, size, "right") - 1
    texts, keys, given = [], [], []
    for step in (0, 1):
        interval = own + step
        some = np.flatnonzero((size > 0) & ((step == 0) | (100 * size >= percent * bounds[np.minimum(interval, len(bounds) - 1)])))
        if not len(some):
            continue
        k = interval[some]
        most = 2 * (bounds[k + 1] - 1) * (100 - percent) // (100 + percent)  # d for the largest sizes
        n = most + 1 + -(-SPARE * (most + 1) // 100)
        base = np.cumsum(n) - n
        where = np.full(len(size), -1)
        where[some] = np.arange(len(some))
        owner = where[np.repeat(np.arange(len(size)), size)]
        mine = owner >= 0
        owner, g = owner[mine], grams[mine]
        block = base[owner] + ((g >> np.uint64(20)) % n[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        block, g = block[order], mix(g[order] + np.uint64(0x5851F42D4C957F2D))
        total = running(g)
        edge = np.searchsorted(block, np.arange(int(n.sum()) + 1))
        count = np.diff(edge)
        text = np.repeat(np.arange(len(some)), n)
        weak = count <= 1
        n_weak = np.bincount(text, weights=weak, minlength=len(some)).astype(np.int64)
        emit = ~weak | (n_weak >= n - most)[text]
        number = np.arange(len(text)) - base[text]
        # 48 bits: two blocks that fall together cost a comparison, no result
        key = mix(total[edge[1:]] - total[edge[:-1]] + mix((k[text] * (1 << 32) + number).astype(np.uint64))) >> np.uint64(16)
        texts.append(some[text[emit]])
        keys.append((key[emit] & ~np.uint64(1)) | (k[text[emit]] & 1).astype(np.uint64))
        given.append(np.where(n_weak >= n - most, most + 1, n - n_weak).astype(np.int32)[text[emit]])
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(texts), np.concatenate(keys), np.concatenate(given)


def parity_sketch(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SKETCH longs for each set: of n-grams that fall on a bit, whether their number is odd.

    Two sketches differ in no more bits than the sets differ in n-grams, so a pair with more such
    bits than its bound can't link.
    """
    bits = 64 * SKETCH
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    odd = np.bincount(owner * bits + (grams % np.uint64(bits)).astype(np.int64), minlength=(len(at) - 1) * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view(np.int64)


def links_needed(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT) -> np.ndarray | int:
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def overlaps(own: np.ndarray, grams: np.ndarray, at: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The overlap of one row of the matrix with each of a block of rows, or -1 where they don't link.

    ``own`` and each of ``grams[at[i]:at[i + 1]]`` are sorted.  Partial products of a block of columns
    add up by row; between blocks, rows go whose overlap with all that is left can't reach the bound.
    """
    size = np.diff(at)
    need = links_needed(len(own), size, percent)
    alive = np.flatnonzero(np.minimum(len(own), size) >= need)
    total = np.zeros(len(size), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    edges = np.linspace(0, 2**64 - 1, COLUMN_BLOCKS + 1)[1:-1].astype(np.uint64)
    column = np.searchsorted(edges, grams, "right")
    cut = [0, *np.searchsorted(own, edges).tolist(), len(own)]
    left = size.copy()
    for k in range(COLUMN_BLOCKS):
        inside = np.zeros(len(size), bool)
        inside[alive] = True
        cells = np.flatnonzero((column == k) & inside[owner])
        mine = own[cut[k] : cut[k + 1]]
        left -= np.bincount(owner[cells], minlength=len(size))
        if len(mine) and len(cells):
            found = np.minimum(np.searchsorted(mine, grams[cells]), len(mine) - 1)
            total += np.bincount(owner[cells[mine[found] == grams[cells]]], minlength=len(size))
        alive = alive[total[alive] + np.minimum(len(own) - cut[k + 1], left[alive]) >= need[alive]]
    out = np.full(len(size), -1, np.int64)
    out[alive] = total[alive]
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link."""
    return bool(overlaps(a, b, np.array([0, len(b)]), percent)[0] >= 0)


def _difference(n: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """The most n-grams in only one of a set of n and a partner of the interval whose parity is ``side``."""
    bounds = size_bounds(percent)
    k = np.searchsorted(bounds, n, "right") - 1
    k += (k & 1) != side
    return (n + np.minimum(bounds[k + 1] - 1, n * 100 // percent)) * (100 - percent) // (100 + percent)


def _matrix_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch, data, at in blocks(batches):
        grams, first = sets(data, at, words)
        sketch = parity_sketch(grams, first)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first)), pa.array(rows_of(grams, first)), *(pa.array(sketch[:, k]) for k in range(SKETCH))], ["id", "key", "n", "row", *_SKETCH])


def _row_blocks(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # rows of this task: copies give their blocks once
    for _, data, at in blocks(batches):
        grams, first = sets(data, at, words)
        row = rows_of(grams, first)
        new = np.zeros(len(row), bool)
        for i, r in enumerate(row.tolist()):
            if r not in seen:
                seen.add(r)
                new[i] = True
        text, key, given = shared_blocks(grams, first, percent)
        most = _difference(np.diff(first)[text], (key & np.uint64(1)).astype(np.int64), percent)
        keep = new[text] & (most > 0)  # where sets may not differ, partners are the same row
        # the block in 48 bits, need in 16 (a lesser one does no harm)
        entry = (key[keep].view(np.int64) << 16) | np.minimum(given[keep] - most[keep], 0xFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(row[text[keep]]), pa.array(entry)], ["row", "entry"])


def _groups(batches: Iterator[pa.RecordBatch], width: int, keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, sizes of the groups) of runs of rows equal in the first ``keys`` columns, each group whole or at most COMMON at a time.

    A group of COMMON rows or more comes in parts, which all count COMMON; nothing larger is held.
    """
    held = np.zeros((width, 0), np.int64)
    long = False  # the held rows follow others of their group, already given out
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(width)])
        rows = np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        begin = np.flatnonzero(np.concatenate([[True], (rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0)]))
        size = np.diff(np.append(begin, rows.shape[1]))
        if long:
            size[0] = COMMON
        last = int(begin[-1])
        if size[-1] >= COMMON:  # keep one row, which tells whether the group goes on
            last, goes_on = rows.shape[1] - 1, True
            size[-1] = COMMON
        else:
            goes_on = False
        counts = np.diff(np.append(begin, rows.shape[1]))
        yield rows[:, :last], np.repeat(np.minimum(size, COMMON), counts)[:last]
        held, long = rows[:, last:], goes_on
    if held.shape[1]:
        yield held, np.full(held.shape[1], COMMON if long else held.shape[1], np.int64)


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, entry) in order of entry and row, those whose block another row has too, with the number of its rows (COMMON at most)."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            row, entry = (batch.column(k).to_numpy() for k in range(2))
            if not len(row):
                continue
            new = np.concatenate([[(int(entry[0]), int(row[0])) != last], (entry[1:] != entry[:-1]) | (row[1:] != row[:-1])])
            last = (int(entry[-1]), int(row[-1]))
            entry = entry[new]
            yield pa.RecordBatch.from_arrays([pa.array(entry >> 16), pa.array(row[new]), pa.array(entry & 0xFFFF)], ["block", "row", "need"])

    for rows, size in _groups(once(batches), 3, 1):
        live = size > 1
        yield pa.RecordBatch.from_arrays([pa.array(rows[0][live]), pa.array(rows[1][live]), pa.array(rows[2][live].astype(np.int32)), pa.array(size[live].astype(np.int32))], ["block", "row", "need", "k"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (block, salt, row) in order, each row with the first of its block and salt."""
    now, hub = None, 0
    for batch in batches:
        block, salt, row = (batch.column(k).to_numpy() for k in range(3))
        if not len(block):
            continue
        begin = np.concatenate([[(int(block[0]), int(salt[0])) != now], (block[1:] != block[:-1]) | (salt[1:] != salt[:-1])])
        first = np.concatenate([[hub], row[begin]])[np.cumsum(begin)]
        now, hub = (int(block[-1]), int(salt[-1])), int(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(first), pa.array(row)], ["block", "a", "b"])


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From (block, lo, hi, tile, row, root, n, sketch) in order of the first three, the pairs of rows in different components that may link.

    Pairs of one tile are compared where it stands alone, those of two tiles where they meet.  A
    group is two tiles of about TILE rows at most.
    """
    held: list[pa.RecordBatch] = []

    def compare(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lo, hi, tile, row, root, n = group[1:7]
        sketch = np.stack(group[7:], axis=1).view(np.uint64)
        x, y = (np.flatnonzero(tile == lo[0]), np.flatnonzero(tile == hi[0])) if lo[0] != hi[0] else (np.arange(len(row)), np.arange(len(row)))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part in np.array_split(x, -(-len(x) * max(len(y), 1) // (1 << 17))) if len(x) else []:
            i, j = (k.ravel() for k in np.meshgrid(part, y, indexing="ij"))
            good = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if lo[0] == hi[0]:
                good &= row[i] < row[j]
            i, j = i[good], j[good]
            most = (n[i] + n[j]) * (100 - percent) // (100 + percent)
            good = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
            found_a.append(np.minimum(row[i[good]], row[j[good]]))
            found_b.append(np.maximum(row[i[good]], row[j[good]]))
        return np.concatenate(found_a), np.concatenate(found_b)

    def pairs(rows: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
        found = [compare([c[x:y] for c in rows]) for x, y in zip(edges[:-1], edges[1:], strict=True) if y - x > 1]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))
        both = np.unique(np.stack([a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        block, lo, hi = (batch.column(k).to_numpy() for k in range(3))
        last = (int(block[-1]), int(lo[-1]), int(hi[-1]))
        if last == tuple(int(held[0].column(k)[0].as_py()) for k in range(3)):
            continue  # one group so far
        rows = [np.concatenate([h.column(k).to_numpy() for h in held]).astype(np.int64) for k in range(7 + SKETCH)]
        begin = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])]))
        yield pairs(rows, begin)
        held = [pa.RecordBatch.from_arrays([pa.array(c[begin[-1] :]) for c in rows], batch.schema.names)]
    if held:
        rows = [np.concatenate([h.column(k).to_numpy() for h in held]).astype(np.int64) for k in range(7 + SKETCH)]
        yield pairs(rows, np.array([0, len(rows[0])]))


def _row_sets(docs: DataFrame, rows: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """row and its set (sorted hashes as bytes) for the rows in pairs, from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in blocks(batches):
            grams, first = sets(data, at, words)
            raw, cut = grams.tobytes(), (8 * first).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rows_of(grams, first)), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["row", "grams"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    own = F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("own")
    chosen = written(rows.select("row", "id", "key").join(wanted, "row", "left_semi").groupBy("row").agg(own).select(F.coalesce("own.id", "own.key").alias("uid")), "chosen")
    # one long for each: other documents that have it too do no harm
    found = docs.withColumn("uid", F.coalesce("id", "key")).join(F.broadcast(chosen) if chosen.count() <= LOOKUP else chosen, "uid", "left_semi").drop("uid")
    out = written(found.mapInArrow(run, "row long, grams binary").dropDuplicates(["row"]), "row-sets")
    forget(chosen)
    return out


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, b, set), with a's own set (b null) first: the pairs that link, and their overlaps."""
    now, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, salt, is_own = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_null().to_numpy(zero_copy_only=False)
        b = batch.column(2).fill_null(0).to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])])) if len(a) else []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(begin, [*begin[1:], len(a)], strict=True):
            if is_own[lo]:
                now, own = (int(a[lo]), int(salt[lo])), np.frombuffer(batch.column(3)[int(lo)].as_py(), np.uint64)
                lo += 1
            if lo == hi or now != (int(a[lo]), int(salt[lo])):
                continue
            cells = [np.frombuffer(x, np.uint64) for x in batch.column(3).slice(int(lo), int(hi - lo)).to_pylist()]
            got = overlaps(own, np.concatenate(cells), np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64), percent)
            yes = got >= 0
            found.append((a[lo:hi][yes], b[lo:hi][yes], got[yes]))
        cols = [np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "overlap"])


def verify(pairs: DataFrame, row_sets: DataFrame, percent: int) -> DataFrame:
    """a, b and overlap of the pairs whose sets link.  Sets of b travel to a; an a of many pairs is split by salt."""
    many = pairs.groupBy("a").agg(F.count("*").alias("m"))
    # written, so that its size is known: few pairs are looked up where the sets are, and only sets in pairs travel
    salted = written(pairs.join(many, "a").select("a", F.pmod(F.hash("b"), F.floor(F.col("m") / STAR).cast("int") + 1).alias("salt"), "b"), "pairs")
    right = salted.join(row_sets.select(F.col("row").alias("b"), "grams"), "b").select("a", "salt", "b", "grams")
    left = salted.select("a", "salt").distinct().join(row_sets.select(F.col("row").alias("a"), "grams"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "grams")
    ordered = left.union(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(lambda it: _verify(it, percent), "a long, b long, overlap long")


def _differ(n: Column, m: Column, percent: int) -> Column:
    """The most n-grams in only one of two sets of these sizes that link."""
    return F.floor((n + m) * (100 - percent) / (100 + percent))


def _facts(of: DataFrame, side: str) -> DataFrame:
    return of.select(F.col("row").alias(side), F.col("n").alias(f"n_{side}"), *[F.col(c).alias(f"{side}{k}") for k, c in enumerate(_SKETCH)])


def _may_link(percent: int) -> Column:
    """Whether sizes and sketches of a and b leave room for a link: sketches differ in no more bits than sets in n-grams."""
    apart = sum((F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}"))) for k in range(SKETCH)), F.lit(0))
    n, m = F.col("n_a"), F.col("n_b")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= _differ(n, m, percent))


def _with_links(links: DataFrame, more: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links and their components, which stay as they are if there are no more links."""
    if more.isEmpty():
        return links, roots
    links = links.unionByName(more)
    return links, components(links)


def matched_rows(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, roots) of (id, text, key): a row for each document, the links between distinct sets, and their components."""
    rows = written(docs.mapInArrow(lambda it: _matrix_rows(it, words), "id long, key long, n long, row long, " + ", ".join(f"{c} long" for c in _SKETCH)), "matrix-rows")
    cut = docs.mapInArrow(lambda it: _row_blocks(it, words, percent), "row long, entry long").repartition(F.shiftright("entry", 16)).sortWithinPartitions("entry", "row")
    shared = written(cut.mapInArrow(_shared_only, "block long, row long, need int, k int"), "shared-blocks")
    # of the c blocks that a row shares, the c - need + 1 rarest: linked rows have one of those in common
    own = shared.withColumn("side", F.expr("block & 1")).repartition("row")
    whole = Window.partitionBy("row", "side")
    own = own.withColumn("c", F.count("*").over(whole)).filter("c >= need").withColumn("place", F.row_number().over(whole.orderBy("k", "block")))
    prefix = written(own.filter("place <= c - need + 1").select("block", "row", "c", "k"), "prefix-blocks")
    facts = written(rows.join(prefix.select("row").distinct(), "row", "left_semi").groupBy("row").agg(F.min("n").alias("n"), *[F.min(c).alias(c) for c in _SKETCH]), "facts")
    forget(shared)

    # the hub of a block is the row that shares the most blocks: it lies in the middle of its copies
    salt = F.when(F.col("k") < COMMON, 0).otherwise(1 + F.pmod(F.hash("row"), F.lit(SALTS)))
    dealt = prefix.withColumn("salt", salt).repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("c").desc(), "row")
    met = dealt.select("block", "salt", "row").mapInArrow(_stars, "block long, a long, b long")
    hubs = met.filter("a = b").groupBy("block").agg(F.collect_list("a").alias("hubs")).filter("size(hubs) > 1")  # one for each salt, so SALTS at most
    among = hubs.select(F.array_min("hubs").alias("a"), F.explode("hubs").alias("b"))
    star = met.select("a", "b").union(among).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("together"))
    star = written(star.join(_facts(facts, "a"), "a").join(_facts(facts, "b"), "b").filter(_may_link(percent)).select("a", "b", "together"), "star")
    row_sets = _row_sets(docs, rows, star, words)
    best = star.groupBy("b").agg(F.max(F.struct("together", "a")).alias("top")).select(F.col("top.a").alias("a"), "b")
    links = written(verify(best, row_sets, percent), "links")
    roots = components(links)

    def root(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    rest = star.select("a", "b").join(best, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = rest.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    links, roots = _with_links(links, written(verify(rest, row_sets, percent), "links"), roots)

    # what is left: rows of one block in different components that haven't met, in tiles of the block
    placed = prefix.join(roots.withColumnRenamed("node", "row"), "row", "left").select("block", "row", F.coalesce("root", "row").alias("root"))
    mixed = placed.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("low <> high")
    open_rows = placed.join(mixed.select("block", F.ceil(F.col("m") / TILE).cast("int").alias("tiles")), "block").join(facts, "row")
    # a row of tile t goes to each pair of tiles that holds t
    mine = F.pmod(F.hash("row"), F.col("tiles"))
    tiled = open_rows.withColumn("tile", mine).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))
    tiled = tiled.repartition("block", "lo", "hi").sortWithinPartitions("block", "lo", "hi").select("block", "lo", "hi", "tile", "row", "root", "n", *_SKETCH)
    across = tiled.mapInArrow(lambda it: _across(it, percent), "a long, b long").distinct()
    across = written(across.join(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        more = _row_sets(docs, rows, across, words)
        links, roots = _with_links(links, written(verify(across, more, percent), "links"), roots)
        forget(more)
    forget(prefix, facts, star, row_sets, across)
    return rows, links, roots


def _placed(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, root) of every document, and (root, least, least_key): the least (id, key) of each component of several."""
    rows, _, roots = matched_rows(docs, words, percent)
    placed = rows.select("id", "key", "n", "row").join(roots.withColumnRenamed("node", "row"), "row", "left").select("id", "key", "n", F.coalesce("root", "row").alias("root"))
    # written, so that the join on components is between plain tables: Spark splits a large component
    least = placed.filter("n > 0 and id is not null").groupBy("root").agg(F.min(F.struct("id", "key")).alias("least"), F.count("*").alias("m")).filter("m > 1")
    return placed, written(least.select("root", F.col("least.id").alias("least"), F.col("least.key").alias("least_key")), "least")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links, its own included), a row for each row of ``df``.

    Null and empty texts have no n-grams and link with nothing: their component is their own id.
    Rows are taken by their texts, so rows that repeat an id with other texts are judged apart.
    Repeated rows and ties have equal sets, and so one component.  A null id stays null, is never
    the least, and links as any other row does.  An empty table gives no rows.  Other columns and
    their names play no part; a text of any length is one set.
    """
    placed, least = _placed(_keyed(df, id_col, text_col), words, percent)
    out = placed.join(least, "root", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(df, id_col, text_col).withColumn("key", F.xxhash64("text"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, percent: int = NEAR_PERCENT) -> DataFrame:
    """One row of ``df`` of each group of near copies, with all its columns: that of the least id, then the least hash of its text.

    Rows are judged one by one: of rows that repeat an id with unrelated texts each stays.  Of rows
    equal in id and text the one with the least hash of all columns stays.  Rows of a null id stay,
    as do null and empty texts (once for each id).
    """
    placed, least = _placed(_keyed(df, id_col, text_col), words, percent)
    found = written(placed.filter("id is not null").join(least, "root", "left").select("id", "key", F.expr("n > 0 and least is not null and (id <> least or key <> least_key)").alias("goes")), "decisions")
    counts = found.groupBy("id", "key").agg(F.max("goes").alias("goes"), F.count("*").alias("rows")).filter("goes or rows > 1")
    odd = written(counts.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("goes").alias("__goes")), "odd-rows")
    forget(found)
    same = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__key"))
    # narrow rows, beside which whole texts would be shuffled
    kept = df.join(F.broadcast(odd) if odd.count() <= LOOKUP else odd, same, "left_anti")
    twice = odd.filter("not __goes")
    if twice.isEmpty():
        return kept
    again = df.join(twice, same).groupBy("__id", "__key").agg(F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns)).alias("__row"))
    return kept.unionByName(again.select("__row.*"))


def op1_blocked_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
