"""Operator 9: SentencePiece encoding and decoding with a unigram model.

The best segmentation of a text has the highest sum of log scores of its
pieces.  A double-array trie of the pieces finds every piece at every byte of
the text, for all distinct words of a block at once, and a Viterbi pass over
positions keeps the best way to each.  Characters without a piece fall back to
byte pieces, so decoding gives back every text exactly.

Spaces become the whitespace marker, with one marker put before a text.  A
marker that stands in the text itself is spelled in byte pieces; that keeps the
two apart.  No piece has a marker after another character, so words (with the
markers before them) are segmented alone, once for each distinct word.

No unigram model is at hand and tokenizers are not trained here: a BPE piece
file gives pieces and ranks, and the log score of rank r is that of a Zipf law,
-ln(r + 1) less the log of their sum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import PerPiece, blocks, id_and_text, read_table

#: Fixed values of the model format: the marker, and what an unknown character scores below the worst piece.
MARKER = "▁"
UNKNOWN_PENALTY = 10.0

_ARROW = pa.schema([("id", pa.int64()), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


class Model:
    """Pieces with log scores, and their double-array trie over bytes (a space stands for the marker).

    A few MB for a vocabulary, whatever the corpus; it is broadcast.
    """

    def __init__(self, path: str | None = None, pieces: list[tuple[str, float]] | None = None):
        if pieces is None:
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
            n = m.GetPieceSize()
            texts = [m.IdToPiece(i) for i in range(n)]
            self.byte_id = np.array([m.PieceToId(f"<0x{b:02X}>") for b in range(256)], np.uint32)
            normal = [i for i in range(n) if not (m.IsByte(i) or m.IsControl(i) or m.IsUnknown(i) or m.IsUnused(i))]
            rank = np.argsort(np.argsort([-m.GetScore(i) for i in normal], kind="stable"))
            score = np.zeros(n)
            score[normal] = -np.log(rank + 1.0) - np.log(np.sum(1.0 / np.arange(1, len(normal) + 1)))
        else:  # normal pieces after the 256 byte pieces
            n = 256 + len(pieces)
            self.byte_id = np.arange(256, dtype=np.uint32)
            texts = [""] * 256 + [t for t, _ in pieces]
            normal = list(range(256, n))
            score = np.concatenate([np.zeros(256), [s for _, s in pieces]])
        # multiples of 2 ** -16 add up exactly, so that ties don't hang on what stands before a word
        self.score = score = np.round(score * 65536.0) / 65536.0
        self.unknown = float(score[normal].min() if normal else 0.0) - UNKNOWN_PENALTY
        spelled = {i: texts[i].replace(MARKER, " ").encode() for i in normal}
        if any(b" " in s.lstrip(b" ") for s in spelled.values()):
            raise ValueError("a piece has a marker after another character")
        bytes_of = [spelled.get(i, b"") for i in range(n)]
        for b, i in enumerate(self.byte_id.tolist()):
            bytes_of[i] = bytes([b])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_id] = True
        self.piece_at = np.concatenate([[0], np.cumsum([len(b) for b in bytes_of])])
        self.piece_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self._double_array(sorted((s, i) for i, s in spelled.items() if s))

    def _double_array(self, keys: list[tuple[bytes, int]]) -> None:
        """base[node] + byte is the child's place; owner[place] says whose child it is."""
        used = bytearray(b"\1" + bytes(1 << 12))
        base, owner, value = {}, {}, {}
        single = many = 1  # where to look for a place: nodes of one child fill the gaps that others leave
        todo = [(0, 0, len(keys), 0)]  # node, keys of its subtree, depth
        while todo:
            node, a, b, depth = todo.pop()
            if a < b and len(keys[a][0]) == depth:
                value[node] = keys[a][1]
                a += 1
            if a == b:
                continue
            edges: list[tuple[int, int]] = []
            for k in range(a, b):
                c = keys[k][0][depth]
                if not edges or edges[-1][0] != c:
                    edges.append((c, k))
            low = edges[0][0]
            slot, misses = used.find(0, max(single if len(edges) == 1 else many, low)), 0
            while True:
                if slot < 0 or slot + 256 > len(used):
                    used += bytes(len(used))
                    slot = used.find(0, max(many, low)) if slot < 0 else slot
                if not any(used[slot - low + c] for c, _ in edges):
                    break
                slot, misses = used.find(0, slot + 1), misses + 1
            if len(edges) == 1:
                single = slot if slot > low else single
            elif misses > 8:
                many = slot
            base[node] = slot - low
            for (c, k), end in zip(edges, [*(k for _, k in edges[1:]), b], strict=True):
                used[slot - low + c] = 1
                owner[slot - low + c] = node
                todo.append((slot - low + c, k, end, depth + 1))
        size = max(owner, default=0) + 257
        self.base, self.owner, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for array, filled in ((self.base, base), (self.owner, owner), (self.value, value)):
            array[list(filled.keys())] = list(filled.values())

    def matches(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every piece in data; one from ``start`` ends at stop[start] at most."""
        start = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        depth, found = 0, []
        while len(start):
            inside = start + depth < stop[start]
            start, node = start[inside], node[inside]
            child = self.base[node] + data[start + depth]
            there = self.owner[child] == node
            start, node = start[there], child[there]
            depth += 1
            ends = self.value[node] >= 0
            found.append((start[ends], start[ends] + depth, self.value[node[ends]]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words joined)."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.concatenate([[0], np.cumsum(n)])
        data = np.frombuffer(b"".join(words), np.uint8)
        if not len(data):
            return n, np.zeros(0, np.uint32)
        word = np.repeat(np.arange(len(n)), n)
        start, end, piece = self.matches(data, at[word + 1])
        head = np.flatnonzero((data & 0xC0) != 0x80)
        next_head = np.append(head[1:], len(data))
        one = np.zeros(len(data) + 1, bool)  # characters that have a piece of their own
        length = np.zeros(len(data), np.int64)
        length[head] = next_head - head
        one[start[end - start == length[start]]] = True
        alone = ~one[head]
        score = np.concatenate([self.score[piece], np.full(int(alone.sum()), self.unknown)])
        start, end, piece = np.concatenate([start, head[alone]]), np.concatenate([end, next_head[alone]]), np.concatenate([piece, np.full(int(alone.sum()), -1)])
        # edges in the order of their end within the word, then of the word, then of their start
        reach = end - at[word[end - 1]]
        order = np.lexsort((start, end, reach))
        start, end, piece, score, reach = start[order], end[order], piece[order], score[order], reach[order]
        best = np.full(len(data) + len(n) + 1, -np.inf)  # a place for each position of each word, its end too
        shift = word  # position p of word w has place p + w
        best[at[:-1] + np.arange(len(n))] = 0.0
        came = np.full(len(best), -1, np.int64)
        from_place, to_place = start + shift[start], end + shift[end - 1]
        steps = np.flatnonzero(np.diff(reach, prepend=-1))
        for a, b in zip(steps.tolist(), np.append(steps[1:], len(reach)).tolist(), strict=True):
            total = best[from_place[a:b]] + score[a:b]
            to = to_place[a:b]
            group = np.flatnonzero(np.diff(to, prepend=-1))
            top = np.maximum.reduceat(total, group)
            hit = np.flatnonzero(total == np.repeat(top, np.diff(np.append(group, b - a))))
            hit = hit[np.diff(to[hit], prepend=-1) != 0]  # among ties the longest piece
            best[to[hit]], came[to[hit]] = total[hit], hit + a
        # back from the end of every word, all words side by side
        here = at[1:] + np.arange(len(n))
        live, steps_back = np.flatnonzero(n > 0), []
        while len(live):
            edge = came[here[live]]
            steps_back.append((live, edge))
            here[live] = from_place[edge]
            live = live[start[edge] > at[live]]
        words_back, edges = (np.concatenate(x) for x in zip(*steps_back, strict=True))
        order = np.lexsort((start[edges], words_back))
        edges, words_back = edges[order], words_back[order]
        unknown = piece[edges] < 0
        width = np.where(unknown, end[edges] - start[edges], 1)
        ids = np.repeat(piece[edges], width).astype(np.uint32)
        offset = np.arange(len(ids)) - np.repeat(np.cumsum(width) - width, width)
        spelled = np.repeat(unknown, width)
        ids[spelled] = self.byte_id[data[(np.repeat(start[edges], width) + offset)[spelled]]]
        return np.bincount(words_back, weights=width, minlength=len(n)).astype(np.int64), ids

    def encode(self, data: np.ndarray, at: np.ndarray, store: PerPiece) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, number of ids of each); an empty text has none."""
        n = np.diff(at)
        full = np.flatnonzero(n > 0)
        new_at = at + np.concatenate([[0], np.cumsum(n > 0)])
        led = np.full(len(data) + len(full), 0x20, np.uint8)
        body = np.ones(len(led), bool)
        body[new_at[:-1][full]] = False
        led[body] = data
        space = led == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[new_at[:-1][full]] = True
        start = np.flatnonzero(cut)
        ids, lengths = store.gather(led, start, np.append(start[1:], len(led)).astype(np.int64)[: len(start)])
        total = np.concatenate([[0], np.cumsum(lengths)])
        first = np.searchsorted(start, new_at)
        return ids, total[first[1:]] - total[first[:-1]]

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts joined, their offsets)."""
        width = self.piece_at[ids + 1] - self.piece_at[ids] if len(ids) else np.zeros(0, np.int64)
        place = np.repeat(self.piece_at[ids] - np.cumsum(width) + width, width) + np.arange(int(width.sum())) if len(ids) else width
        data = self.piece_bytes[place]
        total = np.concatenate([[0], np.cumsum(width)])
        at = total[np.concatenate([[0], np.cumsum(n)])]
        keep = np.ones(len(data), bool)
        keep[at[:-1][n > 0]] = False  # the marker put before the text
        return data[keep], at - np.concatenate([[0], np.cumsum(n > 0)])


_STORES: dict[tuple, PerPiece] = {}


def _store(model: Model) -> PerPiece:
    """The worker's store of word segmentations for this vocabulary."""
    key = (len(model.score), zlib.crc32(model.piece_bytes.tobytes()), zlib.crc32(model.score.tobytes()))
    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = PerPiece(model.segment, np.uint16 if len(model.score) <= 1 << 16 else np.uint32)
    _STORES[key].compute = model.segment
    return _STORES[key]


def _same(model: Model, ids: np.ndarray, n: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the decoded bytes of each text are its own."""
    back, back_at = model.decode(ids, n)
    if len(back) == len(data) and (back_at == at).all():
        wrong = np.concatenate([[0], np.cumsum(back != data)])
        return wrong[at[1:]] == wrong[at[:-1]]
    return np.array([back[c:d].tobytes() == data[a:b].tobytes() for a, b, c, d in zip(at[:-1], at[1:], back_at[:-1], back_at[1:], strict=True)], bool)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """id, ids (array of int) of each text, and whether decoding them gives back the text.

    Null and empty texts have no ids; repeated rows are encoded again; a null id stays null.
    """
    shared = df.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, at in blocks(batches):
            ids, n = model.encode(data, at, _store(model))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(_same(model, ids, n, data, at))], ["id", "ids", "round_trip"])

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id long, ids array<int>, round_trip boolean")


def decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """id and text of each array of ids; null and empty arrays give the empty text."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(Model(model_path))
    own = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = np.diff(lists.offsets.to_numpy())
            data, at = shared.value.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), n)
            texts = pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])

    return own.mapInArrow(run, "id long, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Encode and decode each text: id, n_pieces, n_byte_pieces, ids_crc32 (of the ids as little-endian
    unsigned 32-bit integers) and round_trip (the decoded bytes are those of the text)."""
    shared = df.sparkSession.sparkContext.broadcast(Model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, data, at in blocks(batches):
            ids, n = model.encode(data, at, _store(model))
            same = _same(model, ids, n, data, at)
            cut = np.concatenate([[0], np.cumsum(n)])
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            total = np.concatenate([[0], np.cumsum(model.is_byte[ids])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total[cut[1:]] - total[cut[:-1]]), pa.array(crc, pa.int64()), pa.array(same)], schema=_ARROW)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
