"""A data source of annotated recordings: ``spark.read.format("recordings").load(root)``.

``<root>/<CODE>/<CODE>_<subject>_<trial>_annotated.csv`` becomes rows of code, subj, trial, rec (path), idx,
label and the channels.  The driver plans a fixed number of tasks for each code that filters leave and
lists nothing; a task lists its directory, takes the byte ranges of files that fall to it, and reads
each file's header itself.  So neither paths nor headers pass through the driver, and a long file is read by
several tasks.

Options: ``codes`` (all of the library's), ``channels``, ``tasks`` for each code (8), ``rangeBytes`` (64 MB), and
``labels``: ``own`` keeps rows labelled with their recording's code, ``all`` every row.
"""

from __future__ import annotations

import csv
import io
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull

from ..config import ALL_CODES, CHANNELS
from .recordings import SUFFIX

#: Bytes of a file that are parsed at once.
_CHUNK = 4 << 20
_HEADER = 1 << 20


@dataclass
class Share(InputPartition):
    """One of ``of`` tasks that share the files of a code."""

    code: str
    at: int
    of: int


def parts_of(name: str) -> tuple[int, str] | None:
    """Subject and trial of a file name; None for names that are no recordings.  A subject that is no integer raises."""
    if not name.endswith(SUFFIX):
        return None
    parts = name[: -len(SUFFIX)].split("_")
    return (int(parts[1]), parts[2]) if len(parts) >= 3 else None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def header_of(f: Any) -> tuple[list[str], int]:
    """Column names of a file, and where its first row begins; ([], 0) for an empty file."""
    f.seek(0)
    head, end = b"", -1
    while end < 0 and len(head) < _HEADER:
        more = f.read(1 << 16)
        if not more:
            break
        head += more
        end = head.find(b"\n")
    line = head if end < 0 else head[:end]
    names = next(csv.reader([line.decode("utf-8-sig", "replace").rstrip("\r")]), [])
    return [n.strip() for n in names], len(head) if end < 0 else end + 1


def blocks_of(f: Any, start: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, whole lines) of the lines that begin in [start, stop)."""
    at = start
    if start > 0:
        # a line that begins at start follows a line end just before it
        at = start - 1
        f.seek(at)
        while True:
            more = f.read(1 << 16)
            if not more:
                return
            end = more.find(b"\n")
            if end >= 0:
                at += end + 1
                break
            at += len(more)
    f.seek(at)
    held = b""
    while at < stop:
        more = f.read(min(_CHUNK, max(stop - at - len(held), 1 << 16)))
        held += more
        if not more:
            if held:
                yield at, held
            return
        last = held.rfind(b"\n") + 1
        if at + last > stop:
            # the line that is open at stop - 1 is the last
            last = held.find(b"\n", max(stop - 1 - at, 0)) + 1
        if last:
            yield at, held[:last]
            at, held = at + last, held[last:]


def _doubles(column: pa.Array) -> pa.Array:
    column = pc.utf8_trim_whitespace(column)
    try:
        return pc.cast(column, pa.float64())
    except pa.ArrowInvalid:
        out = []
        for v in column.to_pylist():
            try:
                out.append(None if v is None or "_" in v else float(v))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.float64())


def table_of(block: bytes, names: list[str], wanted: list[str]) -> tuple[np.ndarray, pa.Table]:
    """Where each row begins in the block, and the columns wanted, as strings; empty lines are none.

    A row that is too short has nulls, one that is too long loses what is beyond; fields don't span lines.
    """
    data = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(data == 10)
    if len(data) and data[-1] != 10:
        ends = np.append(ends, len(data))
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    solid = (ends > starts) & ~((ends == starts + 1) & (data[np.minimum(starts, max(len(data) - 1, 0))] == 13)) if len(ends) else np.zeros(0, bool)
    starts, ends = starts[solid], ends[solid]
    at = [names.index(w) for w in wanted]
    columns = [f"c{i}" for i in range(len(names))]
    try:
        got = pacsv.read_csv(
            io.BytesIO(block),
            read_options=pacsv.ReadOptions(column_names=columns, use_threads=False, block_size=len(block) + 1),
            parse_options=pacsv.ParseOptions(newlines_in_values=False),
            convert_options=pacsv.ConvertOptions(include_columns=[columns[i] for i in at], column_types=dict.fromkeys(columns, pa.string()), strings_can_be_null=True, null_values=[""]),
        )
        if got.num_rows == len(starts):
            return starts, got.rename_columns(wanted)
    except (pa.ArrowInvalid, UnicodeDecodeError):
        pass
    rows = [next(csv.reader([block[a:b].decode("utf-8", "replace").rstrip("\r")]), []) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return starts, pa.table({w: pa.array([(r[i] or None) if i < len(r) else None for r in rows], pa.string()) for w, i in zip(wanted, at, strict=True)})


class RecordingsReader(DataSourceReader):
    def __init__(self, root: str, codes: list[str], channels: list[str], tasks: int, size: int, own: bool):
        self.root, self.codes, self.channels, self.tasks, self.size, self.own = root.rstrip("/"), codes, channels, tasks, size, own
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership of ``code`` choose directories; the rest is left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("code",):
                wanted = {f.value}
            elif isinstance(f, In) and f.attribute == ("code",):
                wanted = set(f.value)
            elif isinstance(f, IsNotNull) and f.attribute == ("code",):
                continue
            else:
                yield f
                continue
            self.asked = wanted if self.asked is None else self.asked & wanted

    def partitions(self) -> list[Share]:
        codes = [c for c in self.codes if self.asked is None or c in self.asked]
        # a plan without a task still needs one; it has no code, so it reads nothing
        return [Share(c, i, self.tasks) for c in codes for i in range(self.tasks)] or [Share("", 0, 1)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if not share.code:
            return
        where, root = opened(f"{self.root}/{share.code}")
        files = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        for info in sorted((i for i in files if i.is_file), key=lambda i: i.base_name):
            named = parts_of(info.base_name)
            if named is None:
                continue
            for start in range(0, max(info.size, 1), self.size):
                if zlib.crc32(f"{info.base_name}/{start}".encode()) % share.of == share.at:
                    yield from self._range(where, info.path, share.code, named, start, start + self.size)

    def _range(self, where: fs.FileSystem, path: str, code: str, named: tuple[int, str], start: int, stop: int) -> Iterator[pa.RecordBatch]:
        with where.open_input_file(path) as f:
            names, first = header_of(f)
            if "label" not in names:
                return
            present = [c for c in dict.fromkeys(["label", *self.channels]) if c in names]
            for offset, block in blocks_of(f, max(start, first), stop, self.size) if stop > first else ():
                begins, table = table_of(block, names, present)
                if self.own:
                    keep = pc.fill_null(pc.equal(table["label"], code), False)
                    begins, table = begins[keep.to_numpy()], table.filter(keep)
                n = table.num_rows
                if n == 0:
                    continue
                same = lambda v, kind: pa.repeat(pa.scalar(v, kind), n)
                values = [_doubles(table[c].combine_chunks()) if c in present else same(0.0, pa.float64()) for c in self.channels]
                columns = [same(code, pa.string()), same(named[0], pa.int64()), same(named[1], pa.string()), same(path, pa.string()), pa.array(begins + offset, pa.int64()), table["label"].combine_chunks(), *values]
                yield pa.RecordBatch.from_arrays(columns, ["code", "subj", "trial", "rec", "idx", "label", *self.channels])


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def _channels(self) -> list[str]:
        return [c.strip() for c in self.options.get("channels", ",".join(CHANNELS)).split(",") if c.strip()]

    def schema(self) -> str:
        return ", ".join(["code string, subj long, trial string, rec string, idx long, label string", *(f"`{c}` double" for c in self._channels())])

    def reader(self, schema: Any) -> RecordingsReader:
        own = self.options.get("labels", "own")
        if "path" not in self.options or own not in ("own", "all"):
            raise ValueError("recordings need a path, and labels of 'own' or 'all'")
        codes = [c.strip() for c in self.options.get("codes", ",".join(ALL_CODES)).split(",") if c.strip()]
        return RecordingsReader(self.options["path"], codes, self._channels(), int(self.options.get("tasks", 8)), int(self.options.get("rangeBytes", 64 << 20)), own == "own")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark hand it filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)


def load(spark: SparkSession, root: str, codes: Iterable[str] = ALL_CODES, channels: Iterable[str] = CHANNELS, **options: Any) -> DataFrame:
    """Recordings of the codes under ``root``, a path or URI that pyarrow can open.

    idx is where a row begins in its file, so rows of a file are in its order.  A directory that doesn't exist and a
    file without a label column contribute nothing; a channel that a file lacks is 0; an empty or malformed
    value is null; a null label is nobody's own.  Names without the suffix or with fewer than three parts are no
    recordings; a subject that is no integer raises.
    """
    register(spark)
    reader = spark.read.format("recordings").option("codes", ",".join(codes)).option("channels", ",".join(channels))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(root)
