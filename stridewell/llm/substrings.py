"""Operator 7: substring dedup with compressed FM-indexes.

A window of WINDOW words repeats if its word sequence also starts anywhere else.
Windows are routed to shards by content: a window's minimiser is the least hash
among its runs of SEED words, so equal windows have equal minimisers, and
consecutive windows of a document with one minimiser travel together as one
segment of fewer than 2 * WINDOW words.  A minimiser that occurs once in the
corpus can have no repeated window and goes no further.

A shard joins the distinct segments of its minimisers into one sequence of word
numbers, sorts its suffixes, and keeps the Burrows-Wheeler transform in a
wavelet matrix of packed bits with running counts.  All segments stream through
it side by side: backward search extends a match to the left while it occurs
twice or more; where it ends, the matching statistic there says which windows
repeat, and the search begins anew at the next right end that can matter.

Copies of whole texts are counted first and travel once; equal segments travel
once for each task that has them; a minimiser with very many segments is split
by the content of its windows.  So no shard grows with a hot passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .text import blocks, mix, pieces_hash, read_table, runs_hash, word_spans

WINDOW = 35
SEED = 8
#: Words of a shard, and the segments of a minimiser beyond which its windows are split up.
SHARD_WORDS = 400_000
MANY_SEGMENTS = 4_000


# ---- windows and their minimisers


def minimisers(words: np.ndarray, first: np.ndarray, window: int = WINDOW, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each window, place of its minimiser, hash of that) for all windows inside one text."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    seeds = runs_hash(words, seed)
    starts = np.flatnonzero(text[:n] == text[window - 1 :])
    span = window - seed + 1
    # least of every span: halves that overlap, as in a sparse table
    best, at, width = seeds, np.arange(len(seeds)), 1
    while width * 2 <= span:
        right = best[width:]
        take = right < best[: len(right)]
        at = np.where(take, at[width:], at[: len(right)])
        best = np.where(take, right, best[: len(right)])
        width *= 2
    left, right = starts, starts + span - width
    take = best[right] < best[left]
    return starts, np.where(take, at[right], at[left]), np.where(take, best[right], best[left])


# ---- the index of a shard


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols (at least) from them; after the end come zeros."""
    rank = symbols.astype(np.int64)
    width = 1
    while width < depth:
        key = rank * (int(rank.max(initial=0)) + 1)
        key[: len(rank) - width] += rank[width:]
        order = np.argsort(key, kind="stable")
        step = np.diff(key[order], prepend=key[order[:1]]) != 0
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(step)
        width *= 2
    return np.argsort(rank, kind="stable")


class FmIndex:
    """Backward search over a sequence of numbers of at least 0; patterns have up to ``depth`` of them.

    Bits of the wavelet matrix are packed, 64 to a word, beside a count for each word: about 1.5
    bits for each symbol and level.
    """

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        self.size = n
        order = suffix_order(symbols, depth)
        bwt = symbols[order - 1].astype(np.uint32)  # the symbol before each suffix; the last before the first
        top = int(symbols.max(initial=0)) + 1
        self.levels = max(1, (top - 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top))])
        self.bits, self.counts, self.zeros = [], [], []
        now = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> np.uint32(level)) & 1).astype(bool)
            packed = np.zeros((n >> 6) + 1, np.uint64)
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            now = np.concatenate([now[~bit], now[bit]])
        self.base = np.zeros(top, np.int64)
        self.base = self._down(np.arange(top), np.zeros(top, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word, rest = place >> 6, (place & 63).astype(np.uint64)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            place = np.where(one, self.zeros[k] + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of ``symbol`` before each pattern, from the pattern's own."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        start = self.before[symbol] - self.base[symbol]
        return start + both[: len(low)], start + both[len(low) :]


def repeated_windows(symbols: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each place in the segments symbols[at[i]:at[i + 1]] (numbers from 1), whether the window that begins there occurs twice or more in all."""
    n = np.diff(at)
    # a zero stands after each segment
    place = np.arange(len(symbols)) + np.repeat(np.arange(len(n)), n)
    joined = np.zeros(len(symbols) + len(n), np.int64)
    joined[place] = symbols
    index = FmIndex(joined, depth=int(max(n.max(initial=1), window)) + 1)
    edge = np.zeros(len(symbols) + 1, np.int64)
    live = np.flatnonzero(n >= window)
    end = n[live].copy()
    here, low, high = end.copy(), np.zeros(len(live), np.int64), np.full(len(live), index.size)
    while len(live):
        new_low, new_high = index.extend(symbols[at[live] + here - 1], low, high)
        on = new_high - new_low >= 2
        here = here - on
        low, high = np.where(on, new_low, low), np.where(on, new_high, high)
        stop = ~on | (here == 0)
        if stop.any():
            who = np.flatnonzero(stop)
            hit = who[end[who] - here[who] >= window]
            np.add.at(edge, at[live[hit]] + here[hit], 1)
            np.add.at(edge, at[live[hit]] + end[hit] - window + 1, -1)
            # a window further left can only repeat if it ends before what failed
            end[who] = np.where(here[who] == 0, 0, np.minimum(end[who] - 1, here[who] + window - 1))
            here[who], low[who], high[who] = end[who], 0, index.size
            left = end >= window
            live, end, here, low, high = live[left], end[left], here[left], low[left], high[left]
    return np.cumsum(edge[:-1]) > 0


# ---- tasks


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch, data, at in blocks(batches):
        start, end, first = word_spans(data, at)
        yield batch, data, start, end, first, pieces_hash(data, start, end)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(minimiser, text key, whether the text has it twice), once for each text of a task."""
    seen: set[int] = set()
    for batch, _, _, _, first, words in _keyed(batches):
        keys = batch.column(0).to_numpy()
        new = np.zeros(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            if k not in seen:
                seen.add(k)
                new[i] = True
        starts, place, seed = minimisers(words, first)
        some = np.ones(len(place), bool)
        some[1:] = place[1:] != place[:-1]
        place, seed = place[some], seed[some]
        text = np.searchsorted(first, place, "right") - 1
        mine = new[text]
        text, seed = text[mine], seed[mine]
        order = np.lexsort((seed, text))
        text, seed = text[order], seed[order]
        head = np.ones(len(text), bool)
        head[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
        at = np.flatnonzero(head)
        twice = np.diff(np.append(at, len(text))) > 1
        yield pa.RecordBatch.from_arrays([pa.array(seed[at].view(np.int64)), pa.array(keys[text[at]]), pa.array(twice)], ["seed", "key", "twice"])


def _shared_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (seed, key, twice) in order, those whose seed occurs twice or more."""
    last = np.zeros((3, 0), np.int64)
    shared = False
    for batch in batches:
        rows = np.stack([batch.column(k).cast(pa.int64()).to_numpy() for k in range(3)])
        rows = np.concatenate([last, rows], axis=1)
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        rows = rows[:, new]
        if not rows.shape[1]:
            continue
        same = rows[0, 1:] == rows[0, :-1]
        live = np.concatenate([[shared and last.shape[1] > 0], same]) | (rows[2] > 0)
        live[:-1] |= same
        shared, last = bool(live[-1]), rows[:, -1:]
        done = rows[:, :-1][:, live[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1])], ["seed", "key"])
    if last.shape[1] and shared:
        yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], ["seed", "key"])


_SEGMENT = "segment long, seed long, key long, at long, n long, words string"


def _segment_rows(out: list, names: tuple[str, ...] = ("segment", "seed", "key", "at", "n", "words")) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 5 + (pa.string(),)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], list(names))


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of texts (key, text, seeds): words are given only where a task meets a segment first."""
    seen_keys: set[int] = set()
    seen: set[int] = set()
    for batch, data, start, end, first, words in _keyed(batches):
        keys = batch.column(0).to_pylist()
        lists = batch.column(2)
        flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        starts, place, seed = minimisers(words, first)
        text = np.searchsorted(first, starts, "right") - 1
        # a seed that is live for any text of the batch may be taken for all: it is shared anyway
        live = np.isin(seed, flat)
        head = live.copy()
        head[1:] &= ~live[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(head)
        tail = live.copy()
        tail[:-1] &= ~live[1:] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        stop = np.flatnonzero(tail)
        a, b = starts[begin], starts[stop] + WINDOW
        out, raw = [], data.tobytes()
        new_text = np.ones(len(keys), bool)
        for i, k in enumerate(keys):
            new_text[i] = k not in seen_keys
            seen_keys.add(k)
        byte_a, byte_b = start[a].tolist(), end[b - 1].tolist() if len(b) else []
        for s, i, j, m, p, q in zip(seed[begin].view(np.int64).tolist(), a.tolist(), b.tolist(), text[begin].tolist(), byte_a, byte_b, strict=True):
            if not new_text[m]:
                continue
            words_here = words[i:j].tobytes()
            h = int.from_bytes(hashlib.blake2b(words_here, digest_size=8).digest(), "little", signed=True)
            given = None
            if h not in seen:
                seen.add(h)
                given = raw[p:q].decode()
            out.append((h, s, keys[m], i - int(first[m]), j - i, given))
        yield _segment_rows(out)


def _split_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments (with words) of busy minimisers, as one segment for each window, routed by its content."""
    for batch in batches:
        out = []
        for segment, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer(words.encode(), np.uint8)
            start, end, _ = word_spans(data, np.array([0, len(data)]))
            h = mix(runs_hash(pieces_hash(data, start, end), WINDOW)).view(np.int64)
            for i in range(len(h)):
                out.append((segment, i, int(h[i])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 3)], ["segment", "i", "route"])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (seed, segment, many, words) in order of seed: windows (segment, i) that repeat, as runs (segment, i, n)."""
    held: list[tuple[int, int, bool, str]] = []
    n_bytes, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if n_bytes > 6 * SHARD_WORDS and row[0] != last:
                yield _search_shard(held)
                held, n_bytes = [], 0
            held.append(row)
            n_bytes += len(row[3])
            last = row[0]
    if held:
        yield _search_shard(held)


def _search_shard(held: list[tuple[int, int, bool, str]]) -> pa.RecordBatch:
    raw = [w.encode() for *_, w in held]
    at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, first = word_spans(data, at)
    _, symbols = np.unique(pieces_hash(data, start, end), return_inverse=True)
    many = np.array([m for _, _, m, _ in held], bool)
    found = repeated_windows(symbols + 1, first)
    segment = np.repeat(np.arange(len(held)), np.diff(first))
    i = np.arange(len(symbols)) - first[segment]
    window = i + WINDOW <= np.diff(first)[segment]
    found = (found | many[segment]) & window
    head = found.copy()
    head[1:] &= ~found[:-1] | (segment[1:] != segment[:-1])
    tail = found.copy()
    tail[:-1] &= ~found[1:] | (segment[1:] != segment[:-1])
    a, b = np.flatnonzero(head), np.flatnonzero(tail)
    ids = np.array([s for _, s, _, _ in held], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ids[segment[a]]), pa.array(i[a]), pa.array(b - a + 1)], ["segment", "i", "n"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text, copies, runs of repeated windows): the words that are left."""
    for batch, data, at in blocks(batches):
        start, end, first = word_spans(data, at)
        n = np.diff(first)
        copies = batch.column(2).to_numpy(zero_copy_only=False)
        edge = np.zeros(len(start) + 1, np.int64)
        lists = batch.column(3)
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        if len(flat):
            row = np.repeat(np.arange(batch.num_rows), counts)
            a = first[row] + flat.field("at").to_numpy(zero_copy_only=False)
            b = a + flat.field("n").to_numpy(zero_copy_only=False) + WINDOW - 1
            np.add.at(edge, a, 1)
            np.add.at(edge, np.minimum(b, first[row + 1]), -1)
        gone = np.cumsum(edge[:-1]) > 0
        gone |= np.repeat((copies > 1) & (n >= WINDOW), n)
        raw = data.tobytes()
        kept, shas = ~gone, []
        a, b = start[kept].tolist(), end[kept].tolist()
        cut = np.concatenate([[0], np.cumsum(kept)])[first].tolist()
        for k in range(batch.num_rows):
            shas.append(b" ".join([raw[x:y] for x, y in zip(a[cut[k] : cut[k + 1]], b[cut[k] : cut[k + 1]], strict=True)]))
        texts = [s.decode() for s in shas]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(n - np.diff(np.array(cut))), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept"])


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_removed and kept (the words left, joined by a space), a row for each row of ``df``.

    Null and empty texts have no words.  Repeated rows and copies of a text repeat each other, so
    they lose every word if they have a window at all.  A null id stays null.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    texts = written(docs.groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("rep")), "texts")
    ordered = docs.select("key", "text").mapInArrow(_seeds, "seed long, key long, twice boolean").repartition("seed").sortWithinPartitions("seed", "key", F.col("twice").desc())
    live = written(ordered.mapInArrow(_shared_seeds, "seed long, key long"), "seeds")
    of_text = live.groupBy("key").agg(F.collect_set("seed").alias("seeds")).join(texts.select("key", "rep"), "key")

    rep = of_text.select(F.col("key").alias("k"), "rep", "seeds")
    joined = docs.join(rep, (docs.key == rep.k) & docs.id.eqNullSafe(rep.rep)).select("key", "text", "seeds")
    segments = written(joined.mapInArrow(_segments, _SEGMENT), "segments")
    told = segments.groupBy("segment").agg(F.count("*").alias("m"), F.min("seed").alias("seed"), F.max("words").alias("words"))
    told = written(told, "distinct-segments")

    busy = told.groupBy("seed").agg(F.count("*").alias("c")).filter(F.col("c") > MANY_SEGMENTS).select("seed")
    plain = told.join(busy, "seed", "left_anti")
    search = "segment long, i long, n long"
    ordered = plain.select("seed", "segment", (F.col("m") > 1).alias("many"), "words").repartition("seed").sortWithinPartitions("seed", "segment")
    runs = ordered.mapInArrow(_search, search)
    # windows of busy minimisers: equal ones are found by their hash, with partial counts before the shuffle
    split = written(told.join(busy, "seed", "left_semi").select("segment", "words").mapInArrow(_split_windows, "segment long, i long, route long"), "busy-windows")
    often = split.join(told.select("segment", "m"), "segment").groupBy("route").agg(F.sum("m").alias("times")).filter("times > 1")
    more = split.join(often, "route", "left_semi").select("segment", "i", F.lit(1).cast("long").alias("n"))
    found = written(runs.union(more), "repeated")

    where = segments.select("segment", "key", "at").join(found, "segment").select("key", F.struct((F.col("at") + F.col("i")).alias("at"), F.col("n").alias("n")).alias("run"))
    of_text = where.groupBy("key").agg(F.collect_list("run").alias("runs"))
    state = texts.join(of_text, "key", "left").filter("copies > 1 or runs is not null").select("key", "copies", F.coalesce("runs", F.array().cast("array<struct<at:bigint,n:bigint>>")).alias("runs"))
    out = docs.join(state, "key", "left").select("id", "text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("runs", F.array().cast("array<struct<at:bigint,n:bigint>>")).alias("runs"))
    return out.mapInArrow(_keep, "id long, n_words long, n_removed long, kept string")


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
