"""Training on Spark: softmax regression on feature columns, for all folds at once.

Rows stay where they are.  A pass over them gives, for each fold's model, the gradient of the weighted
cross-entropy summed over the rows outside the fold; a task adds up its own rows, and tasks' sums add
up in two steps to one row of fixed size, (folds, features + 1, classes) numbers, which is all that the
driver sees.  There the optimizer takes its step: Adam, or the two passes of sharpness-aware
minimisation.  A step uses every row, so a result depends on no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators import moments
from ..shared import written

#: Folds whose models are fitted together at most; a model is of fixed size, and so is what they send.
MOST_FOLDS = 64
#: Tasks that add up the sums of all tasks, before one adds up theirs.
ADDERS = 16


class AdamSteps:
    """Adam with decay added to the gradient, over arrays whose first axis is that of folds."""

    def __init__(self, shape: tuple[int, ...], lr: float, decay: float):
        self.lr, self.decay, self.t = lr, decay, 0
        self.m, self.v = np.zeros(shape), np.zeros(shape)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        g = g + self.decay * w
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return w - self.lr * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def gradient(x: np.ndarray, y: np.ndarray, fold: np.ndarray, w: np.ndarray, weights: np.ndarray, mu: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums over rows, flat: for each fold the gradient, then the loss and the weight of its training rows.

    w (folds, features + 1, classes), weights of classes (folds, classes), mu and scale (folds, features): features are
    (x - mu) * scale, and scale is 0 where a fold doesn't use one.
    """
    out = []
    for f in range(len(w)):
        mine = fold != f
        z = np.column_stack([(x[mine] - mu[f]) * scale[f], np.ones(mine.sum())])
        logits = z @ w[f]
        logits -= logits.max(1, keepdims=True)
        logs = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        label, rows = y[mine], np.arange(mine.sum())
        own = weights[f][label]
        d = np.exp(logs)
        d[rows, label] -= 1
        out.append(np.concatenate([(z.T @ (d * own[:, None])).ravel(), [-(own * logs[rows, label]).sum(), own.sum()]]))
    return np.concatenate(out)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class LinearTrainer:
    """Softmax regression by fold on a DataFrame of (y int from 0, fold int from 0, feat array<double>)."""

    def __init__(self, rows: DataFrame, classes: int, folds: int, settings: Settings = DEFAULTS):
        if not 0 < folds <= MOST_FOLDS:
            raise ValueError(f"between 1 and {MOST_FOLDS} folds are fitted together")
        self.rows, self.classes, self.folds, self.settings = rows.select("y", "fold", "feat"), classes, folds, settings
        chosen = {r.fold: r for r in moments.select_for_each_fold(self.rows, "fold", "feat", settings.var_threshold, settings.corr_threshold).collect()}  # one row a fold
        size = max((r.n for r in self.rows.agg(F.max(F.size("feat")).alias("n")).collect()), default=0) or 0
        self.mu, self.scale = np.zeros((folds, size)), np.zeros((folds, size))
        for f, r in chosen.items():
            self.mu[f, r.kept], self.scale[f, r.kept] = r.mu, 1 / np.array(r.sd)
        counts = np.zeros((folds, classes))
        for r in self.rows.groupBy("fold", "y").count().collect():  # folds times classes
            counts[r.fold, r.y] = r["count"]
        used = np.maximum(counts.sum(0) - counts, 1)
        self.weights = used.sum(1, keepdims=True) / (classes * used)
        self.w = np.zeros((folds, size + 1, classes))
        self.losses: list[list[float]] = []

    def _sums(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean gradient and mean loss of each fold at ``w``."""
        weights, mu, scale = self.weights, self.mu, self.scale

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for b in batches:
                if b.num_rows:
                    total = total + gradient(_matrix(b.column(2)), b.column(0).to_numpy(), b.column(1).to_numpy(), w, weights, mu, scale)
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    part = _matrix(b.column(0)).sum(0)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

        sums = self.rows.mapInArrow(own, "s array<double>").repartition(ADDERS).mapInArrow(add, "s array<double>").repartition(1).mapInArrow(add, "s array<double>").collect()
        if not sums:
            raise ValueError("no rows to train on")
        s = np.array(sums[0].s).reshape(self.folds, -1)
        weight = np.maximum(s[:, -1:], 1e-300)
        return (s[:, :-2] / weight).reshape(w.shape), s[:, -2] / weight[:, 0]

    def fit(self, mode: str = "erm", steps: int | None = None) -> LinearTrainer:
        """``steps`` (the settings' epochs) steps of ``erm`` or ``sam``; losses has those of each step by fold, in sam of its second pass."""
        if mode not in ("erm", "sam"):
            raise ValueError("a linear model has the modes erm and sam")
        if mode == "sam" and self.settings.rho < 0:
            raise ValueError("rho must not be negative")
        adam = AdamSteps(self.w.shape, self.settings.lr, self.settings.weight_decay)
        self.rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for _ in range(self.settings.epochs if steps is None else steps):
                g, loss = self._sums(self.w)
                if mode == "sam":
                    norm = np.sqrt((g * g).sum((1, 2), keepdims=True))
                    g, loss = self._sums(self.w + self.settings.rho * g / (norm + 1e-12))
                self.w = adam.step(self.w, g)
                self.losses.append(loss.tolist())
        finally:
            self.rows.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` (with fold and feat) and ``p``, the class that the model of the row's own fold finds; the first of equal ones."""
        w, mu, scale = self.w, self.mu, self.scale
        names = df.columns
        kind = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, p int"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    fold, x = b.column(names.index("fold")).to_numpy(), _matrix(b.column(names.index("feat")))
                    z = np.column_stack([(x - mu[fold]) * scale[fold], np.ones(len(x))])
                    p = np.einsum("nd,ndk->nk", z, w[fold]).argmax(1).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*names, "p"])

        return df.mapInArrow(run, kind)


def fit_predict_linear(df: DataFrame, mode: str = "erm", steps: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """window_id, fold, y and p for every row of (window_id, y string, fold int from 0, feat array<double>).

    Classes are the labels in order; folds are few (MOST_FOLDS).  Rows with a null in them train nothing and aren't
    predicted; an empty table gives no rows.
    """
    rows = written(df.select("window_id", "y", "fold", "feat").filter("y is not null and fold is not null and feat is not null"), "train-rows")
    labels = [r.y for r in rows.select("y").distinct().orderBy("y").collect()]  # as many as classes
    if not labels:
        return rows.select("window_id", "fold", "y", F.col("y").alias("p"))
    names = F.array(*[F.lit(v) for v in labels])
    coded = rows.withColumn("label", F.col("y")).withColumn("y", (F.array_position(names, F.col("y")) - 1).cast("int"))
    folds = rows.agg(F.max("fold")).first()[0] + 1
    model = LinearTrainer(coded, len(labels), folds, settings).fit(mode, steps)
    out = model.predict(coded.select("window_id", "fold", "label", "feat"))
    return out.select("window_id", "fold", F.col("label").alias("y"), names[F.col("p")].alias("p"))
