"""Operator 4: token ids in length-delimited binary records.

Each text is encoded whole and becomes one record: the payload's length as an
unsigned 64-bit integer, the masked CRC-32C of those 8 bytes, the payload (ids
as little-endian unsigned integers of 16 or 32 bits), and its masked CRC-32C.
Beside each data file lies an index with a fixed-size entry for each record, so
that any record can be read alone, in any order.

Writers range-partition the texts by id, so the files hold ascending ids; each
task writes its own pair of files under a name of its own attempt, and only
files in the manifest (one row per file) count, so a lost executor or a
speculative copy leaves nothing behind that is read.  Files are reached through
``pyarrow.fs``, which takes local paths, HDFS and object stores alike.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import shared_folder
from .text import PerPiece, blocks, id_and_text, read_table

#: Fixed values of the record format: the mask of checksums, and the reversed polynomial of CRC-32C.
MASK_DELTA = 0xA282EAD8
POLYNOMIAL = 0x82F63B78

INDEX = np.dtype([("id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("n_ids", "<u4")])
MANIFEST = "part int, data string, index string, width int, n_docs long, n_tokens long, n_bytes long"
_MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("data", pa.string()), ("index", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
_ROWS_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_COLUMNS = 128


# ---- checksums of many records at once


@lru_cache(maxsize=1)
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


@lru_cache(maxsize=64)
def _skip_tables(level: int) -> np.ndarray:
    """Four tables of a byte each that carry a state over _COLUMNS * 2 ** level zero bytes."""
    if level == 0:
        state = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(_COLUMNS):
            state = _byte_table()[state & 0xFF] ^ (state >> 8)
        return state.reshape(4, 256)
    half = _skip_tables(level - 1)
    return _skip(_skip(np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]), half), half).reshape(4, 256)


def _skip(state: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0][state & 0xFF] ^ t[1][(state >> 8) & 0xFF] ^ t[2][(state >> 16) & 0xFF] ^ t[3][state >> 24]


def crc32c(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """CRC-32C of data[at[i]:at[i + 1]] for each i.

    The first four bytes are inverted instead of the starting state, after which zeros in front
    change nothing: each record is cut into rows of equal length from its end, all rows run side
    by side, and each row's state is carried over the rows behind it.
    """
    n = np.diff(at)
    padded = n + np.where(n < 4, 4 - n, 0)  # short ones are redone below
    rows = -(-padded // _COLUMNS)
    first = np.cumsum(rows) - rows
    grid = np.zeros(int(rows.sum()) * _COLUMNS, np.uint8)
    begin = (first + rows) * _COLUMNS - n
    place = np.repeat(begin - at[:-1], n) + np.arange(at[0], at[-1])
    grid[place] = data[at[0] : at[-1]]
    long_enough = np.flatnonzero(n >= 4)
    for k in range(4):
        grid[begin[long_enough] + k] ^= 0xFF
    table, state = _byte_table(), np.zeros(int(rows.sum()), np.uint32)
    for column in np.ascontiguousarray(grid.reshape(-1, _COLUMNS).T):
        state = table[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    behind = np.repeat(rows, rows) - 1 - (np.arange(len(state)) - np.repeat(first, rows))
    level = 0
    while (behind >> level).any():
        some = np.flatnonzero((behind >> level) & 1)
        state[some] = _skip(state[some], _skip_tables(level))
        level += 1
    out = ~np.bitwise_xor.reduceat(state, first) if len(state) else np.zeros(0, np.uint32)
    for i in np.flatnonzero(n < 4):
        s = 0xFFFFFFFF
        for b in data[at[i] : at[i + 1]].tolist():
            s = int(table[(s ^ b) & 0xFF]) ^ (s >> 8)
        out[i] = s ^ 0xFFFFFFFF
    return out.astype(np.uint32)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payload: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the records, offset of each): payload bytes with their lengths and checksums around."""
    n = np.diff(at)
    offset = np.concatenate([[0], np.cumsum(n + 16)])
    out = np.empty(int(offset[-1]), np.uint8)
    heads = n.astype("<u8").view(np.uint8)
    for where, values, width in ((0, heads, 8), (8, masked(crc32c(heads, np.arange(0, 8 * len(n) + 1, 8))).astype("<u4").view(np.uint8), 4)):
        out[(offset[:-1, None] + where + np.arange(width)).ravel()] = values
    out[np.repeat(offset[:-1] + 12 - at[:-1], n) + np.arange(at[0], at[-1])] = payload[at[0] : at[-1]]
    out[(offset[1:, None] - 4 + np.arange(4)).ravel()] = masked(crc32c(payload, at)).astype("<u4").view(np.uint8)
    return out, offset[:-1]


def unframe(data: np.ndarray, offset: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(payload bytes joined, their offsets) of records at the given offsets; raises if a length or checksum is wrong."""
    heads = data[(offset[:, None] + np.arange(8)).ravel()]
    said = data[(offset[:, None] + 8 + np.arange(4)).ravel()].view("<u4")
    if (heads.view("<u8") != n.astype(np.uint64)).any() or (masked(crc32c(heads, np.arange(0, 8 * len(n) + 1, 8))) != said).any():
        raise ValueError("a record's length is damaged")
    at = np.concatenate([[0], np.cumsum(n)])
    payload = data[np.repeat(offset + 12 - at[:-1], n) + np.arange(at[-1])]
    said = data[((offset + 12 + n)[:, None] + np.arange(4)).ravel()].view("<u4")
    if (masked(crc32c(payload, at)) != said).any():
        raise ValueError("a record's payload is damaged")
    return payload, at


# ---- encoding


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[PerPiece, int]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()

    def compute(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [x.ids for x in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return lengths, np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))

    size = tokenizer.get_vocab_size(with_added_tokens=True)
    return PerPiece(compute, np.uint16 if size <= 1 << 16 else np.uint32), 2 if size <= 1 << 16 else 4


def piece_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a text can be cut so that its pieces have the tokens of the whole.

    A byte-level BPE with the usual pattern never joins a single space to what stands before it,
    so a cut is made before a space that has no white space on either side.  Next to bytes that
    may belong to other white space no cut is made.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
    near = space[data]
    odd = np.isin(data, [0xC2, 0xE1, 0xE2, 0xE3])
    cut = data == 0x20
    cut[1:] &= ~near[:-1]
    cut[:-1] &= ~(near | odd)[1:]
    for back in (2, 3):
        cut[back:] &= ~odd[:-back]
    cut[at[:-1][at[:-1] < n]] = True
    return np.flatnonzero(cut)


def encode(data: np.ndarray, at: np.ndarray, store: PerPiece) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts joined, number of ids of each)."""
    start = piece_starts(data, at)
    ids, lengths = store.gather(data, start, np.concatenate([start[1:], [len(data)]]).astype(np.int64) if len(start) else start)
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(start, at)
    return ids, total[first[1:]] - total[first[:-1]]


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    store, width = _encoder(path)
    part = TaskContext.get().partitionId()
    system, root = fs.FileSystem.from_uri(folder)
    name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
    offset = n_tokens = n_docs = 0
    with system.open_output_stream(f"{root}/{name}.records") as out, system.open_output_stream(f"{root}/{name}.index") as index:
        for batch, data, at in blocks(batches):
            ids, n = encode(data, at, store)
            place = np.cumsum(n + 1) - 1  # of each end id
            whole = np.full(len(ids) + len(n), end_id, f"<u{width}")
            body = np.ones(len(whole), bool)
            body[place] = False
            whole[body] = ids
            framed, where = frame(whole.view(np.uint8), np.concatenate([[0], (place + 1) * width]))
            out.write(framed.tobytes())
            rows = np.zeros(len(n), INDEX)
            key = batch.column(0)
            rows["id"], rows["has_id"] = key.fill_null(0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)
            rows["offset"], rows["n_ids"] = where + offset, n + 1
            index.write(rows.tobytes())
            offset, n_tokens, n_docs = offset + len(framed), n_tokens + len(whole), n_docs + len(n)
    if n_docs:
        yield pa.RecordBatch.from_pylist([{"part": part, "data": f"{folder}/{name}.records", "index": f"{folder}/{name}.index", "width": width, "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": offset}], schema=_MANIFEST_ARROW)


def write_records(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Encode each text, append ``end_id`` and write records in ascending id under ``folder`` (a URI); returns the manifest.

    Null and empty texts become a record of ``end_id`` alone; a null id comes first and stays null;
    repeated rows become repeated records, and rows of one id come in the order of their texts; an
    empty table gives an empty manifest.  Other columns and their names play no part.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
    ordered = id_and_text(df, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(lambda it: _write(it, folder, path, end_id), MANIFEST).write.mode("overwrite").parquet(manifest)
    return df.sparkSession.read.schema(MANIFEST).parquet(manifest)


def _read(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(file, index rows, payload bytes, their offsets), in stretches of about ``chunk`` bytes."""
    for batch in batches:
        for file in batch.to_pylist():
            system, path = fs.FileSystem.from_uri(file["index"])
            with system.open_input_stream(path) as f:
                index = np.frombuffer(f.read(), INDEX)
            size = index["n_ids"].astype(np.int64) * file["width"]
            stop = index["offset"].astype(np.int64) + size + 16
            with system.open_input_file(fs.FileSystem.from_uri(file["data"])[1]) as f:
                row = 0
                while row < len(index):
                    a = int(index["offset"][row])
                    end = max(row + 1, int(np.searchsorted(stop, a + chunk, "right")))
                    f.seek(a)
                    data = np.frombuffer(f.read(int(stop[end - 1]) - a), np.uint8)
                    yield file, index[row:end], *unframe(data, index["offset"][row:end].astype(np.int64) - a, size[row:end])
                    row = end


def read_records(manifest: DataFrame, chunk: int = 4 << 20) -> DataFrame:
    """One row per record, checked against its checksums: doc_id, start (ids in all records before), n_tokens, ids_crc32."""
    # one row per file: a window over all of them is small
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)
    n = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, int] = {}
        for file, index, payload, at in _read(batches, chunk):
            n_ids = index["n_ids"].astype(np.int64)
            start = file["before"] + done.get(file["part"], 0) + np.cumsum(n_ids) - n_ids
            done[file["part"]] = done.get(file["part"], 0) + int(n_ids.sum())
            ids = payload.view(f"<u{file['width']}").astype("<u4").tobytes()
            cut = (at // file["width"] * 4).tolist()
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(index["id"], mask=index["has_id"] == 0), pa.array(start), pa.array(n_ids), pa.array(crc, pa.int64())], schema=_ROWS_ARROW)

    return files.repartitionByRange(max(n, 1), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_index(manifest: DataFrame) -> DataFrame:
    """The index entries of all files: doc_id, data (file), width, offset and n_tokens of each record, without its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(file["index"])
                with system.open_input_stream(path) as f:
                    index = np.frombuffer(f.read(), INDEX)
                n = len(index)
                yield pa.RecordBatch.from_arrays([pa.array(index["id"], mask=index["has_id"] == 0), pa.array([file["data"]] * n, pa.string()), pa.array([file["width"]] * n, pa.int32()), pa.array(index["offset"].astype(np.int64)), pa.array(index["n_ids"].astype(np.int64))], ["doc_id", "data", "width", "offset", "n_tokens"])

    return manifest.mapInArrow(run, "doc_id long, data string, width int, offset long, n_tokens long")


def read_at(entries: DataFrame) -> DataFrame:
    """doc_id and ids of the records at entries of ``read_index``, in the order and the partitions of ``entries``.

    Each record is read alone from its offset and held against its checksums; entries may be any
    part of the index, shuffled or repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, pa.NativeFile] = {}
        for batch in batches:
            found = []
            for data, width, offset, n in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if data not in files:
                    system, path = fs.FileSystem.from_uri(data)
                    files[data] = system.open_input_file(path)
                files[data].seek(offset)
                raw = np.frombuffer(files[data].read(n * width + 16), np.uint8)
                payload, _ = unframe(raw, np.zeros(1, np.int64), np.array([n * width]))
                found.append(payload.view(f"<u{width}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return entries.select("doc_id", "data", "width", "offset", "n_tokens").mapInArrow(run, "doc_id long, ids array<bigint>")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex[:12]}"
    return read_records(write_records(read_table(spark, sf_dir, "documents"), folder))
