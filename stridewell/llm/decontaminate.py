"""Operator 10: benchmark decontamination by template canonicalisation.

Numbers, names and units are replaced by typed placeholders in benchmark items
and documents alike; windows of the resulting templates are joined by hash, and
so are windows of the plain words in lower case: an item dense with numbers or
names, or a copy in other capitals, has no template to be found by.
Where windows of an item meet those of a document on one diagonal, they form
stretches, and the slots of a stretch must be consistent: each value of the
item stands for one value in the document (two values may get the same one).
Of a stretch that isn't, the windows copied as they are still count.  That
catches verbatim copies and questions whose numbers or names were changed, and
leaves chance matches of templates alone.

The windows of the benchmark are looked up inside tasks, in one pass over the
documents, where their measured size allows a broadcast; beyond that the same
windows are joined by a shuffle as narrow rows, and texts are fetched only for
the pairs of a document and an item that share windows enough for a hit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import forget, written
from .text import blocks, id_and_text, mix, pieces_hash, ragged, read_table, runs_hash, word_spans

#: Tokens of a window, and the fixed (not placeholder) ones it must have.
WINDOW = 8
MIN_FIXED = 4
#: A document holds an item if this share of the item's windows is met, or a run of so many tokens.
COVERAGE = 0.5
RUN = 13
#: Words with capitals in a row that are no names.
SHOUTED = 4
#: Bytes of benchmark text that are broadcast at most (their arrays take about ten times that).
BROADCAST_BYTES = 16 << 20

#: Beyond so many items a window is salted, its documents over so many groups.
HOT = 1_000
SALTS = 16

# Words that stand for units of measure.
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers
mg g kg gram grams kilogram kilograms ounce ounces pound pounds ton tons tonne tonnes
ml l litre litres liter liters gallon gallons
second seconds minute minutes hour hours day days week weeks month months year years
degree degrees celsius fahrenheit percent dollar dollars cent cents euro euros
""".split()

NUMBER, NAME, UNIT = 1, 2, 3
_MARK = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], np.uint64)
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

HITS = "id long, item_id long, n_windows long, n_item_windows long, coverage double, longest_run long, n_changed_slots long"
_ARROW = pa.schema([("id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("n_item_windows", pa.int64()), ("coverage", pa.float64()), ("longest_run", pa.int64()), ("n_changed_slots", pa.int64())])


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    start, end, _ = word_spans(data, np.array([0, len(data)]))
    return np.sort(pieces_hash(data, start, end))


_UNIT_HASHES = _unit_hashes()


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hash, value hash and kind of each token, first token of each text).

    A token is a word without the punctuation around it, in lower case; words of punctuation alone
    don't count.  It is a number if it has a digit, a unit if listed, and a name if it has a capital
    but doesn't begin a sentence and isn't one of SHOUTED or more such words in a row, as in headings
    and texts in capitals.
    """
    start, end, first = word_spans(data, at)
    solid = np.flatnonzero(_SOLID[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    ends_sentence = np.zeros(len(start), bool)
    if len(start):
        last = data[end - 1]
        ends_sentence = (last == 0x2E) | (last == 0x21) | (last == 0x3F) | (last == 0x3A)
        lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
        ends_sentence[:-1] |= lines[start[1:]] > lines[end[:-1]]
    begins = np.ones(len(start), bool)
    begins[1:] = ends_sentence[:-1]
    begins[first[:-1][first[:-1] < len(start)]] = True
    start, end, begins = solid[a[some]], solid[b[some] - 1] + 1, begins[some]
    counts = np.concatenate([[0], np.cumsum(some)])
    first = counts[first]
    # capitals of the Latin-1 letters are lowered as well
    low = data.copy()
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1 if len(data) else np.zeros(0, np.int64)
    low[wide] += 0x20
    value = pieces_hash(low, start, end, lower=True)
    kind = np.zeros(len(start), np.int8)
    if len(start):
        capital = ((data[start] >= 65) & (data[start] <= 90)) | np.isin(start + 1, wide)
        edge = np.flatnonzero(np.diff(capital, prepend=~capital[:1]) | np.isin(np.arange(len(start)), first))
        in_row = np.repeat(np.diff(np.append(edge, len(start))), np.diff(np.append(edge, len(start))))
        kind[capital & ~begins & (in_row < SHOUTED)] = NAME
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        kind[np.isin(value, _UNIT_HASHES)] = UNIT
        kind[digits[end] > digits[start]] = NUMBER
    return np.where(kind > 0, _MARK[kind], value), value, kind, first


def windows(words: np.ndarray, kind: np.ndarray, first: np.ndarray, n: int, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the windows of n tokens inside one text.

    Of templates those with enough fixed tokens; of plain words (values) those with a slot, as the
    others are templates already.
    """
    if len(words) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fixed = np.concatenate([[0], np.cumsum(kind == 0)])
    fixed = fixed[n:] - fixed[:-n]
    good = (text[: len(text) - n + 1] == text[n - 1 :]) & (fixed < n if plain else fixed >= min(MIN_FIXED, n))
    return np.flatnonzero(good), mix(runs_hash(words, n) + np.uint64(n))[good]


class Templates:
    """Windows of benchmark items, sorted by hash.

    An item of fewer tokens than a window has one window of its own length; one of fewer than
    MIN_FIXED tokens has none, as it can't be told from chance.  A window of fewer than MIN_FIXED
    fixed tokens is met by its plain words alone.
    """

    def __init__(self, ids: Sequence[int], texts: Sequence[str]):
        raw = [t.encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.ids = np.array(ids, np.int64)
        template, self.value, self.kind, self.first = tokens(np.frombuffer(b"".join(raw), np.uint8), at)
        size = np.diff(self.first)
        owner = np.repeat(np.arange(len(size)), size)
        self.lengths = sorted({int(n) for n in np.minimum(size, WINDOW) if n >= MIN_FIXED})
        place, keys, length, templated = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        # in the middle of a sentence the first word of an item looks like a name
        led, led_kind = template.copy(), self.kind.copy()
        heads = self.first[:-1][size > 0]
        heads = heads[led_kind[heads] == 0]
        led[heads], led_kind[heads] = _MARK[NAME], NAME
        for n in self.lengths:
            p, h = windows(template, self.kind, self.first, n)
            p2, h2 = windows(led, led_kind, self.first, n)
            again = np.isin(p2, heads)
            templated.append(p[np.minimum(size[owner[p]], WINDOW) == n])
            p3, h3 = windows(self.value, self.kind, self.first, n, plain=True)
            p, h = np.concatenate([p, p2[again], p3]), np.concatenate([h, h2[again], h3])
            mine = size[owner[p]] == n if n < WINDOW else size[owner[p]] >= n
            place.append(p[mine])
            keys.append(h[mine])
            length.append(np.full(int(mine.sum()), n))
        place, keys, length = np.concatenate(place), np.concatenate(keys), np.concatenate(length)
        order = np.lexsort((place, keys))
        self.place, self.keys, self.length = place[order], keys[order], length[order]
        self.item = owner[self.place] if len(self.place) else self.place
        self.n_windows = np.bincount(owner[np.unique(self.place)], minlength=len(size)) if len(self.place) else np.zeros(len(size), np.int64)
        # those that are found with other values too
        self.templated = np.zeros(len(owner), bool)
        self.templated[np.concatenate([np.zeros(0, np.int64), *templated])] = True
        self.n_templated = np.bincount(owner[self.templated], minlength=len(size))

    def find(self, template: np.ndarray, value: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the texts, row of a window here) of every meeting."""
        at, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.lengths:
            for p, h in (windows(template, kind, first, n), windows(value, kind, first, n, plain=True)):
                low, high = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
                met = np.flatnonzero(high > low)
                width = (high - low)[met]
                at.append(np.repeat(p[met], width))
                rows.append(np.repeat(low[met], width) + ragged(width))
        return np.concatenate(at), np.concatenate(rows)

    def agreeing(self, here: np.ndarray, shift: int, n: int, kind: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Those of the windows ``here`` (sorted, on one diagonal) that count.

        A stretch of windows that touch counts whole if no value of the item stands for two there;
        otherwise its windows with the item's own values count.
        """
        kept = []
        for stretch in np.split(here, np.flatnonzero(np.diff(here) > n) + 1):
            at = np.arange(stretch[0], stretch[-1] + n)
            mine, other = self.value[at - shift], value[at]
            slots = kind[at] > 0
            pairs = set(zip(mine[slots].tolist(), other[slots].tolist(), strict=True))
            if len(pairs) > len({m for m, _ in pairs}):
                changed = np.concatenate([[0], np.cumsum(slots & (mine != other))])
                begin = stretch - stretch[0]
                stretch = stretch[changed[begin + n] == changed[begin]]
            kept.append(stretch)
        return np.concatenate(kept)

    def hits(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, float, int, int]]:
        """(text, item id, windows met, windows of the item, coverage, longest run, changed slots) of each text and item that agree."""
        template, value, kind, first = tokens(data, at)
        pos, row = self.find(template, value, kind, first)
        if not len(pos):
            return []
        doc = np.searchsorted(first, pos, "right") - 1
        item, shift = self.item[row], pos - self.place[row]
        order = np.lexsort((pos, shift, item, doc))
        doc, item, shift, pos, row = doc[order], item[order], shift[order], pos[order], row[order]
        new = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0) | (np.diff(shift, prepend=shift[0] - 1) != 0))
        found: dict[tuple[int, int], list] = {}
        for a, b in zip(new.tolist(), np.append(new[1:], len(doc)).tolist(), strict=True):
            n = int(self.length[row[a]])
            here = self.agreeing(np.unique(pos[a:b]), int(shift[a]), n, kind, value)
            if not len(here):
                continue
            covered = np.unique(here[:, None] + np.arange(n))
            slots = covered[kind[covered] > 0]
            breaks = np.flatnonzero(np.diff(covered) > 1)
            run = int(np.diff(np.concatenate([[-1], breaks, [len(covered) - 1]])).max())
            met, longest, changed = found.setdefault((int(doc[a]), int(item[a])), [set(), 0, 0])
            met.update((here - shift[a]).tolist())
            found[int(doc[a]), int(item[a])][1:] = [max(longest, run), changed + int((self.value[slots - shift[a]] != value[slots]).sum())]
        out = []
        for (d, i), (met, run, changed) in found.items():
            # of all windows, or of those that other values leave as they are, whichever is the larger share
            n, of = len(met), int(self.n_windows[i])
            m, among = int(self.templated[list(met)].sum()), int(self.n_templated[i])
            if m * of > n * among:
                n, of = m, among
            share = n / of
            if share >= COVERAGE or run >= RUN:
                out.append((d, int(self.ids[i]), n, of, share, run, changed))
        return out


def _rows(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    ids = batch.column(0).to_pylist()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([ids[h[0]] for h in found], *([h[k] for h in found] for k in range(1, 7))), _ARROW, strict=True)], schema=_ARROW)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row (HITS) for each document and benchmark item that it holds.

    Null and empty texts hold nothing; repeated rows of a document give repeated hits, those of a
    null id hits of a null id; benchmark rows without an id or a text are left out, repeated ones
    count once; an empty benchmark or an empty table gives no rows.  Texts of any length are looked
    at whole; ties (items of the same windows) each give a row; other columns of either table and
    their names play no part.  Both ways, by lookup and by join, give the same rows.
    """
    spark = docs.sparkSession
    own = id_and_text(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("item_text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size <= broadcast_bytes:
        rows = items.orderBy("item_id", "item_text").collect()
        shared = spark.sparkContext.broadcast(Templates([r.item_id for r in rows], [r.item_text for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, data, at in blocks(batches):
                yield _rows(batch, shared.value.hits(data, at))

        return own.mapInArrow(run, HITS)

    return _joined(own, items)


def _enough(places: list[int], n: int, least: int) -> bool:
    """Whether windows at these places of an item, on whatever diagonals, could make a hit."""
    if len(places) >= COVERAGE * least:
        return True
    covered = np.unique(np.add.outer(np.array(places, np.int64), np.arange(n)))
    edges = np.flatnonzero(np.diff(covered, prepend=covered[0] - 2, append=covered[-1] + 2) > 1)
    return int(np.diff(edges).max()) >= RUN


def _joined(own: DataFrame, items: DataFrame) -> DataFrame:
    """HITS by a shuffle join; documents are known by a hash of their text, whatever their id."""

    def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                t = Templates([0], [text])
                if len(t.keys):
                    least = int(min(c for c in (t.n_windows[0], t.n_templated[0]) if c))
                    item = batch.column(0).take(pa.array(np.full(len(t.keys), k)))
                    yield pa.RecordBatch.from_arrays([pa.array(t.keys.view(np.int64)), item, pa.array(t.place, pa.int32()), pa.array(t.length, pa.int32()), pa.array(np.full(len(t.keys), least), pa.int32())], ["key", "item", "place", "n", "least"])

    items = items.withColumn("item", F.unhex(F.md5(F.concat_ws(":", "item_id", "item_text"))))
    mine = written(items.select("item", "item_text").mapInArrow(item_windows, "key long, item binary, place int, n int, least int"), "item-windows")
    lengths = sorted(r.n for r in mine.select("n").distinct().collect())

    def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in blocks(batches):
            template, value, kind, first = tokens(data, at)
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            for n in lengths:
                p, h = (np.concatenate(x) for x in zip(windows(template, kind, first, n), windows(value, kind, first, n, plain=True), strict=True))
                order = np.lexsort((h, row[p]))
                r, h = row[p][order], h[order]
                new = (np.diff(r, prepend=-1) != 0) | (np.diff(h, prepend=~h[:1]) != 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r[new])), pa.array(h[new].view(np.int64))], ["doc", "key"])

    keyed = own.withColumn("doc", F.unhex(F.md5("text")))
    texts = keyed.select("doc", "text").dropDuplicates(["doc"])
    # hot windows: at most one in HOT of the benchmark's
    hot = F.broadcast(mine.groupBy("key").count().filter(F.col("count") > HOT).select("key", F.ceil(F.col("count") / HOT).cast("int").alias("deal")))
    deal, salts = F.coalesce("deal", F.lit(1)), F.when(F.col("deal").isNull(), 1).otherwise(SALTS)
    left = texts.mapInArrow(doc_windows, "doc binary, key long").join(hot, "key", "left").select("doc", "key", F.pmod(F.xxhash64("doc"), salts).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), deal - 1)).alias("dealt"))
    right = mine.join(hot, "key", "left").select("item", "key", "place", "n", "least", F.pmod(F.xxhash64("item"), deal).cast("int").alias("dealt"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # as many places as the item has windows, at most
    met = left.join(right, ["key", "salt", "dealt"]).groupBy("doc", "item", "n", "least").agg(F.collect_set("place").alias("places"))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, least, places = (batch.column(k).to_pylist() for k in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array([_enough(*x) for x in zip(places, n, least, strict=True)], pa.bool_())) for c in batch.columns[:2]], ["doc", "item"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, doc, text, item_id, item_text = (batch.column(k).to_pylist() for k in range(5))
            found = []
            for k, body in enumerate(text):
                raw = np.frombuffer(body.encode(), np.uint8)
                found += [(k, *h[1:]) for h in Templates([item_id[k]], [item_text[k]]).hits(raw, np.array([0, len(raw)]))]
            yield pa.RecordBatch.from_arrays([pa.array([doc[h[0]] for h in found], pa.binary()), *(pa.array([h[k] for h in found], _ARROW[k].type) for k in range(1, 7))], ["doc", *_ARROW.names[1:]])

    pairs = met.mapInArrow(filtered, "doc binary, item binary").join(texts, "doc").join(items, "item")
    hits = pairs.select("item", "doc", "text", "item_id", "item_text").mapInArrow(check, HITS.replace("id long", "doc binary", 1))
    return keyed.select("id", "doc").join(hits, "doc").select(*_ARROW.names)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """The rows of ``df`` whose text holds no benchmark item, with all their columns.

    Each row is judged by its own text, whatever its id: rows of a null id or of one that others
    have too stay or go by themselves, and equal texts alike.  Null and empty texts stay; an empty
    table gives no rows, an empty benchmark drops none.  (Texts are known by a 64-bit hash.)
    """
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    hits = written(contamination(df.select(text.alias("text_id"), F.col(text_col).alias("text")), benchmark, "text_id", **columns), "hits")
    gone = written(hits.select(F.col("id").alias("__gone")).distinct(), "gone")
    forget(hits)
    return df.join(gone, text == F.col("__gone"), "left_anti")


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
