"""Array kernels on UTF-8 text that the operators use inside Spark tasks.

A task gets Arrow batches of whole texts.  Everything here works on the bytes
of such a batch at once: where its words are, a 64-bit hash of each, and values
that are computed once for each distinct word and then gathered.  Memory is a
small multiple of one block of text (``BLOCK`` bytes, or one document if that
is longer), whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a task.
BLOCK = 1 << 20
#: Pieces whose values are computed at once, and those that a store keeps.
AT_ONCE = 1 << 14
MOST_PIECES = 1_000_000
#: Characters that end a word: space and U+0009 to U+000D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS = {_BASE: np.ones(1, np.uint64), _BASE_INV: np.ones(1, np.uint64)}


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``id`` and ``text`` (null text as empty), so that other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _POWERS[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    if len(have) <= 4 * BLOCK:
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column without nulls."""
    if pa.types.is_large_string(column.type):
        wide = np.int64
    else:
        wide = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch of (id, text) in slices of about ``size`` bytes, with the bytes and offsets of their texts."""
    for batch in batches:
        data, at = string_bytes(batch.column(batch.schema.get_field_index("text")))
        row = 0
        while row < batch.num_rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
            yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def pieces_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each piece of bytes; pieces are in order and don't overlap."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, a + BLOCK, "right")))
        span = data[a : int(end[j - 1])]
        if lower:
            span = _LOWER[span]
        total = np.zeros(len(span) + 1, np.uint64)
        np.cumsum(_BYTE[span] * powers(_BASE, len(span)), out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((total[e] - total[s]) * powers(_BASE_INV, len(span) + 1)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and (one more than documents) the first word of each document."""
    solid = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    starts = solid & (np.concatenate([[True], ~solid[:-1]])[: len(data)] | first[:-1])
    ends = solid & (np.concatenate([~solid[1:], [True]])[: len(data)] | first[1:])
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def chars_before(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte position (one more than bytes)."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def sum_by(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def runs_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n words from each position (of len(words) - n + 1 positions)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return mix(out)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0 .. length - 1 for each length, joined."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class PerPiece:
    """Arrays of values computed once for each distinct piece of text and gathered for all pieces.

    ``compute(list of pieces as bytes)`` returns (lengths, values, ...): the values of all pieces
    joined.  The store lives in a Python worker and starts anew beyond ``most`` pieces, so its
    memory is bounded; results don't depend on it.
    """

    def __init__(self, compute: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], dtype: type, most: int = MOST_PIECES):
        self.compute, self.dtype, self.most = compute, dtype, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.values = np.zeros(1, np.int64), [np.zeros(0, self.dtype)]

    def rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of each piece, offsets of the rows, values of the rows)."""
        hashes = pieces_hash(data, start, end)
        keys, first, row = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > max(self.most, len(keys)):
            self.clear()
        found = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = found < len(self.keys)
        known[inside] = self.keys[found[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            lengths, values, base = [], [], len(self.at) - 1
            for i in range(0, len(new), AT_ONCE):
                some = first[new[i : i + AT_ONCE]]
                n, v = self.compute([raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)])
                lengths.append(n)
                values.append(np.asarray(v, self.dtype))
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(lengths))])
            self.values = [np.concatenate([*self.values, *values])]
            self.keys = np.insert(self.keys, found[new], keys[new])
            self.place = np.insert(self.place, found[new], base + np.arange(len(new)))
        return self.place[np.searchsorted(self.keys, keys)][row], self.at, self.values[0]

    def gather(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all pieces joined, number of values of each piece)."""
        row, at, values = self.rows(data, start, end)
        lengths = at[row + 1] - at[row]
        return values[np.repeat(at[row], lengths) + ragged(lengths)], lengths
