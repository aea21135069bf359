"""Handcrafted features of windows and their selection.

The formulas are this library's own: for each channel mean, deviation, least, most, range and root
mean square; magnitudes of acceleration and rotation; jerk; tilt; spectral energy and the dominant
frequency of the first acceleration channel.  They are taken over Arrow batches of windows, spectra by a
real FFT of all channels at once (``spectra`` has them for every channel).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..config import CHANNELS, DEFAULTS
from . import moments

STATS = ("mean", "std", "min", "max", "range", "rms")


def feature_names(channels: Sequence[str] = CHANNELS) -> list[str]:
    own = [f"{c}_{s}" for c in channels for s in STATS]
    return [*own, "acc_mag_mean", "acc_mag_std", "acc_mag_max", "gyro_mag_mean", "gyro_mag_std", "gyro_mag_max", "jerk_mean_abs", "jerk_max_abs", "tilt_mean", "tilt_range", "spectral_energy", "dominant_bin"]


def power(x: np.ndarray) -> np.ndarray:
    """Squared magnitudes of the Fourier coefficients 1 .. W // 2 along the last axis, by a real FFT.

    What is rounding beside the signal itself is 0, so a constant has no power.
    """
    p = np.abs(np.fft.rfft(x, axis=-1)[..., 1 : x.shape[-1] // 2 + 1]) ** 2
    return np.where(p > 1e-20 * x.shape[-1] * (x * x).sum(-1, keepdims=True), p, 0.0)


def windows_array(column: pa.Array) -> np.ndarray:
    """A column of windows (channels, samples), all of one shape, as doubles of three axes."""
    channels = column.flatten()
    count = len(channels) // max(len(column), 1)
    return channels.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), count, -1)


def feature_matrix(x: np.ndarray, rate: float) -> np.ndarray:
    """The features of windows (rows, six channels, samples), in the order of feature_names()."""
    mean, square = x.mean(-1), (x * x).mean(-1)
    low, high = x.min(-1), x.max(-1)
    own = np.stack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), low, high, high - low, np.sqrt(square)], -1).reshape(len(x), -1)
    acc, gyro = (np.sqrt((x[:, c : c + 3] ** 2).sum(1)) for c in (0, 3))
    jerk = np.abs(np.diff(acc, axis=1)) * rate
    tilt = np.arccos(np.clip(np.divide(x[:, 2], acc, out=np.ones_like(acc), where=acc != 0), -1, 1))
    p = power(x[:, 0])
    deviation = lambda m: np.sqrt(np.maximum((m * m).mean(1) - m.mean(1) ** 2, 0))
    rest = [acc.mean(1), deviation(acc), acc.max(1), gyro.mean(1), deviation(gyro), gyro.max(1), jerk.mean(1), jerk.max(1), tilt.mean(1), np.ptp(tilt, 1), p.sum(1), p.argmax(1) + 1.0]
    return np.column_stack([own, *rest])


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    flat = pa.array(np.ascontiguousarray(values, np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), flat)


def _beside(windows: DataFrame, name: str, kind: ArrayType, f: Callable[[np.ndarray], pa.Array]) -> DataFrame:
    """``windows`` with f of its windows (three axes) as the column ``name``."""
    kept = [c for c in windows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, f(windows_array(batch.column(kept.index("x"))))], [*kept, name])

    return windows.select(kept).mapInArrow(run, StructType([*windows.select(kept).schema, StructField(name, kind)]))


def extract(windows: DataFrame, rate: float = DEFAULTS.target_hz) -> DataFrame:
    """``windows`` with ``feat``, an array in the order of feature_names(); ``x`` has six channels of one length.

    Windows without rows give none; a window that is null, or has a null in it, raises.
    """

    return _beside(windows, "feat", ArrayType(DoubleType()), lambda x: _lists(feature_matrix(x, rate)))


#: Edges of the bands of spectra(), as shares of the highest frequency.
BANDS = (0.0, 0.2, 0.5, 1.0)


def spectra(windows: DataFrame, bands: Sequence[float] = BANDS) -> DataFrame:
    """``windows`` with ``spectra``, for each channel of ``x`` a struct of energy, dominant, entropy and bands.

    energy sums the power of all frequencies but 0, dominant is the first bin of the highest power (0 for a constant),
    entropy that of the shares of power, between 0 and 1, and bands the share of energy in each band (0 for a constant).
    """
    doubles = ArrayType(DoubleType())
    kind = ArrayType(StructType([StructField("energy", DoubleType()), StructField("dominant", IntegerType()), StructField("entropy", DoubleType()), StructField("bands", doubles)]))

    def of(w: np.ndarray) -> pa.Array:
        p = power(w).reshape(-1, w.shape[2] // 2)
        energy = p.sum(1)
        share = np.divide(p, energy[:, None], out=np.zeros_like(p), where=energy[:, None] > 0)
        entropy = -(share * np.log(share, out=np.zeros_like(share), where=share > 0)).sum(1) / np.log(max(p.shape[1], 2))
        bins = np.arange(1, p.shape[1] + 1) / p.shape[1]
        parts = np.column_stack([share[:, (bins > lo) & (bins <= hi)].sum(1) for lo, hi in zip(bands, bands[1:], strict=False)])
        each = pa.StructArray.from_arrays([pa.array(energy), pa.array(np.where(energy > 0, p.argmax(1) + 1, 0).astype(np.int32)), pa.array(entropy), _lists(parts)], ["energy", "dominant", "entropy", "bands"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), each)

    return _beside(windows, "spectra", kind, of)


def _whole(df: DataFrame, feat: str) -> moments.Moments | None:
    """The moments of all rows, from one pass; None for an empty table."""
    rows = moments.whole(df, feat).collect()  # one row of fixed size
    return moments.Moments(rows[0].n, np.array(rows[0].mean), np.reshape(rows[0].m2, (len(rows[0].mean), -1))) if rows else None


def variances(df: DataFrame, feat: str = "feat") -> DataFrame:
    """pos and var (population) of each position; rows with a null in ``feat`` are left out."""
    m = _whole(df, feat)
    return df.sparkSession.createDataFrame([] if m is None else [(i, float(v / m.n)) for i, v in enumerate(np.maximum(np.diag(m.m2), 0))], "pos int, var double")


def correlated_pairs(df: DataFrame, positions: Sequence[int], feat: str = "feat", threshold: float = DEFAULTS.corr_threshold) -> DataFrame:
    """a, b, r of the pairs of positions whose correlation is beyond the threshold.

    One pass takes the matrix of products about the mean.  Pairs with a constant side have no correlation.
    """
    m, out = _whole(df, feat), []
    if m is not None:
        d = np.sqrt(np.maximum(np.diag(m.m2), 0))
        for i, a in enumerate(positions):
            for b in positions[i + 1 :]:
                if d[a] > 0 and d[b] > 0 and abs(m.m2[a, b] / (d[a] * d[b])) > threshold:
                    out.append((a, b, float(m.m2[a, b] / (d[a] * d[b]))))
    return df.sparkSession.createDataFrame(out, "a int, b int, r double")


def select_positions(df: DataFrame, feat: str = "feat", var_threshold: float = DEFAULTS.var_threshold, corr_threshold: float = DEFAULTS.corr_threshold) -> list[int]:
    """Positions kept: variance above the threshold, then in order, none correlated with one already kept; one pass."""
    m = _whole(df, feat)
    return [] if m is None else moments.greedy(m, var_threshold, corr_threshold)[0]


def keep(df: DataFrame, kept: Sequence[int], feat: str = "feat") -> DataFrame:
    return df.withColumn(feat, F.array(*[F.col(feat)[p] for p in kept]))
