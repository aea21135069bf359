"""Moments of vectors by group that add up and take away: counts, means and matrices of products.

A task turns the rows of a group in each Arrow batch into one (n, mean, m2), m2 being the matrix of
products about the mean, where that is smaller than the rows themselves.  Two of them merge by the
pairwise update of Chan, Golub and LeVeque, and a part comes out of a whole by the same formula
backwards, so statistics of everyone but one subject cost a subtraction each: leave-one-subject-out over
S subjects reads the rows once, not S times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..shared import written

#: Groups whose moments a task holds before it hands them on (each a matrix; a batch of single vectors may have thousands of groups).
GROUPS = 64
_MOMENTS = "n long, mean array<double>, m2 array<double>"


class Moments:
    """n, mean and m2 of some rows."""

    __slots__ = ("n", "mean", "m2")

    def __init__(self, n: int, mean: np.ndarray, m2: np.ndarray):
        self.n, self.mean, self.m2 = n, mean, m2

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(0)
        d = x - mean
        return cls(len(x), mean, d.T @ d)

    def __add__(self, other: Moments) -> Moments:
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.m2 + other.m2 + np.outer(d, d) * (self.n * other.n / n))

    def __sub__(self, part: Moments) -> Moments:
        n = self.n - part.n
        if n == 0:
            return Moments(0, np.zeros_like(self.mean), np.zeros_like(self.m2))
        mean = self.mean + (self.mean - part.mean) * (part.n / n)
        d = part.mean - mean
        return Moments(n, mean, self.m2 - part.m2 - np.outer(d, d) * (part.n * n / self.n))


def _batch(groups: Sequence[object], moments: Sequence[Moments], schema: pa.Schema) -> pa.RecordBatch:
    columns = [list(groups), [m.n for m in moments], [m.mean for m in moments], [m.m2.ravel() for m in moments]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(group: pa.DataType) -> pa.Schema:
    doubles = pa.list_(pa.float64())
    return pa.schema([("g", group), ("n", pa.int64()), ("mean", doubles), ("m2", doubles)])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[object, int, int]]:
    """(group, first row, row after the last) of rows whose groups come together."""
    code = batch.column(0).dictionary_encode(null_encoding="encode")
    at, names = code.indices.to_numpy(), code.dictionary.to_pylist()
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for i, j in zip(edges, edges[1:], strict=False):
        if j > i:
            yield names[at[i]], i, j


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _added(n: np.ndarray, mean: np.ndarray, m2: pa.Array) -> Moments:
    """The moments of rows (n, mean, m2), those without m2 being single vectors."""
    full = np.flatnonzero(m2.is_valid().to_numpy(zero_copy_only=False))
    single = np.setdiff1d(np.arange(len(n)), full)
    parts = [Moments.of(mean[single])] if len(single) else []
    for i in full.tolist():
        parts.append(Moments(int(n[i]), mean[i], m2[i].values.to_numpy().reshape(mean.shape[1], -1)))
    out = parts[0]
    for m in parts[1:]:
        out = out + m
    return out


def _read(batch: pa.RecordBatch) -> Iterator[tuple[object, Moments]]:
    """(group, moments) of a batch of (g, n, mean, m2), its rows being sorted by group."""
    n, mean = batch.column(1).to_numpy(), _vectors(batch.column(2))
    for g, i, j in _runs(batch):
        yield g, _added(n[i:j], mean[i:j], batch.column(3).slice(i, j - i))


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, x) as (g, n, mean, m2): a group with more rows in a batch than a matrix has columns becomes one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        schema, x = _schema(batch.schema.field(0).type), _vectors(batch.column(1))
        code = batch.column(0).dictionary_encode(null_encoding="encode")
        at, names = code.indices.to_numpy(), code.dictionary.to_pylist()
        many = np.bincount(at, minlength=len(names)) > x.shape[1]
        held = {i: Moments.of(x[at == i]) for i in np.flatnonzero(many).tolist()}
        if held:
            yield _batch([names[i] for i in held], list(held.values()), schema)
        few = pa.array(np.flatnonzero(~many[at]))
        if len(few):
            size = len(few)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(few), pa.array(np.ones(size, np.int64)), batch.column(1).take(few).cast(schema.field(2).type), pa.nulls(size, schema.field(3).type)], schema=schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, n, mean, m2) that come sorted by g, one for each g."""
    done, now, schema = [], None, None
    for batch in batches:
        schema = schema or _schema(batch.schema.field(0).type)
        for g, m in _read(batch):
            if now is not None and now[0] == g:
                now = (g, now[1] + m)
            else:
                if now is not None:
                    done.append(now)
                now = (g, m)
                if len(done) >= GROUPS:
                    yield _batch(*zip(*done, strict=True), schema)
                    done = []
    if now is not None:
        yield _batch(*zip(*done, now, strict=True), schema)


def moments(df: DataFrame, by: str, x: str) -> DataFrame:
    """by, n, mean and m2 (row by row) of the vectors ``x`` of each group; null is a group too.

    Rows without a vector, or with a null in it, are left out; vectors are all of one length.  Less than the vectors
    is shuffled; of a group that holds most of the rows, a row for each batch of them.
    """
    kind = df.schema[by].dataType.simpleString()
    rows = df.select(F.col(by).alias("g"), F.col(x).cast("array<double>").alias("x")).filter("x is not null and not exists(x, v -> v is null)")
    own = f"g {kind}, {_MOMENTS}"
    parts = rows.mapInArrow(_first, own).repartition("g").sortWithinPartitions("g")
    return parts.mapInArrow(_merge, own).withColumnRenamed("g", by)


def total(parts: DataFrame) -> DataFrame:
    """n, mean and m2 of all groups together, one row (none for an empty table): each task adds its own, one adds those."""
    rows = parts.select(F.lit(0).alias("g"), "n", "mean", "m2")
    own = f"g int, {_MOMENTS}"
    return rows.mapInArrow(_merge, own).repartition(1).mapInArrow(_merge, own).drop("g")


def whole(df: DataFrame, x: str) -> DataFrame:
    """n, mean and m2 of the vectors ``x`` of all rows; a task sends one row."""
    rows = df.select(F.lit(0).alias("g"), F.col(x).cast("array<double>").alias("x")).filter("x is not null and not exists(x, v -> v is null)")
    return total(rows.mapInArrow(_first, f"g int, {_MOMENTS}"))


def greedy(m: Moments, var_threshold: float, corr_threshold: float) -> tuple[list[int], np.ndarray]:
    """Positions kept, and the population deviations: variance above the threshold, then in order, none that
    correlates beyond the other threshold with one kept before."""
    var = np.maximum(np.diag(m.m2), 0) / max(m.n, 1)
    sd = np.sqrt(var)
    alive = np.flatnonzero(var > var_threshold)
    r = np.abs(m.m2[np.ix_(alive, alive)]) / max(m.n, 1) / np.outer(sd[alive], sd[alive])
    kept: list[int] = []
    for i in range(len(alive)):
        if not (r[i, kept] > corr_threshold).any():
            kept.append(i)
    return alive[kept].tolist(), sd


def _select(batches: Iterator[pa.RecordBatch], out: pa.Schema, var_threshold: float, corr_threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (g, n, mean, m2, n, mean, m2): the selection of the second less the first, and its statistics."""
    for batch in batches:
        names = [f.name for f in batch.schema]
        wholes = pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[4:7]], names[:4])
        rows = []
        for i in range(batch.num_rows):
            (g, own), (_, whole) = next(_read(batch.slice(i, 1))), next(_read(wholes.slice(i, 1)))
            rest = whole - own
            kept, sd = greedy(rest, var_threshold, corr_threshold)
            rows.append((g, own.n, rest.n, kept, rest.mean[kept], np.where(sd[kept] == 0, 1.0, sd[kept])))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(out)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def select_for_each_fold(df: DataFrame, by: str, x: str, var_threshold: float = DEFAULTS.var_threshold, corr_threshold: float = DEFAULTS.corr_threshold) -> DataFrame:
    """by, n_test, n_train, kept, mu and sd: what each fold's training rows, those of all other groups, select.

    kept has positions of ``x`` in order; mu and sd (population) are theirs, to standardise both sides of
    the fold.  A single group leaves no training rows, so it keeps nothing; a null group is a fold too; an empty
    table has no folds.  The moments of all rows, one row of fixed size, are broadcast.
    """
    kind = df.schema[by].dataType.simpleString()
    own = written(moments(df, by, x), "moments")
    whole = total(own).select(F.col("n").alias("n_"), F.col("mean").alias("mean_"), F.col("m2").alias("m2_"))
    pairs = own.join(F.broadcast(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.schema([("g", batch.schema.field(0).type), ("n_test", pa.int64()), ("n_train", pa.int64()), ("kept", pa.list_(pa.int32())), ("mu", pa.list_(pa.float64())), ("sd", pa.list_(pa.float64()))])
            yield from _select(iter([batch]), out, var_threshold, corr_threshold)

    return pairs.mapInArrow(run, f"{by} {kind}, n_test long, n_train long, kept array<int>, mu array<double>, sd array<double>")


def standardize_for_each_fold(df: DataFrame, by: str, x: str, folds: DataFrame) -> DataFrame:
    """``df`` with ``x`` as its own fold sees it as test rows: the positions kept, standardised, as floats.

    ``folds`` is select_for_each_fold().  Each row goes to the one fold that tests it, so nothing is replicated.
    """
    few = folds.select(F.col(by).alias("__g"), "kept", "mu", "sd")
    out = df.join(few, F.col(by).eqNullSafe(F.col("__g")))
    z = F.transform(F.arrays_zip("kept", "mu", "sd"), lambda s: ((F.get(F.col(x), s["kept"]).cast("double") - s["mu"]) / s["sd"]).cast("float"))
    return out.withColumn(x, z).drop("__g", "mu", "sd")
