"""Training and prediction by fold: every window outside a fold trains its model, batch after batch.

A step starts from the model that the step before left, so a fit is a chain, but its windows never meet in one task:
the order of an epoch is arithmetic, its batches lie in chunks of CHUNK steps, and a job for each chunk takes all fits
that far, a task for each, which holds one batch of windows.  Between jobs models and optimizers lie in the shared
folder; what standardises and selects comes from moments of all training windows, merged by fold.  Every window is
predicted where it is, by the model of its own fold from a broadcast; beyond MODELS in groups of (seed, fold, salt).
Rows are standardised as doubles and trained on as floats.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators import features, moments
from ..operators.epochs import numbered, placed
from ..shared import forget, written
from .kernels import Adam, Network, SharpnessAware

#: Steps of every fit that a job takes; 64 batches of 512 windows of the default shape are some 50 MB.
CHUNK = 64
SALTS = 8
#: Hexadecimal digits by which windows are counted for a sample.
DIGITS = 3
#: Models (well below 1 MB each) that are broadcast at most; with more, as by subject, each meets its own fold's rows.
MODELS = 64


def _weights(counts: np.ndarray) -> np.ndarray:
    counts = np.maximum(counts, 1)
    return counts.sum() / (len(counts) * counts)


def class_weights(y: np.ndarray, n: int) -> np.ndarray:
    return _weights(np.bincount(y, minlength=n))


def select(feat: np.ndarray, settings: Settings = DEFAULTS) -> np.ndarray:
    """Positions kept on training rows: enough variance, not correlated with one kept before."""
    alive = np.flatnonzero(feat.var(axis=0) > settings.var_threshold)
    r = np.abs(np.atleast_2d(np.corrcoef(feat[:, alive], rowvar=False))) if len(alive) else np.zeros((0, 0))
    kept: list[int] = []
    for i in range(len(alive)):
        if not any(r[i, j] > settings.corr_threshold for j in kept):
            kept.append(i)
    return alive[kept]


class Steps:
    """A network in training: its optimizer and the weights of classes."""

    def __init__(self, net: Network, weight: np.ndarray, mode: str, settings: Settings = DEFAULTS):
        self.net, self.weight, self.settings = net, weight, settings
        self.adam = Adam(net.p, settings.lr, settings.weight_decay)
        self.sam = SharpnessAware(self.adam, settings.rho) if mode in ("sam", "sam_fic") else None

    def step(self, x: np.ndarray, y: np.ndarray, feat: np.ndarray | None) -> tuple[float, float, float]:
        """One batch, and its losses."""
        batch = (x, y, self.weight, feat, self.settings.consistency_weight)
        loss, ce, cons = self.net.loss(*batch)
        loss.backward()
        if self.sam:
            self.sam.first_step()
            loss, ce, cons = self.net.loss(*batch)
            loss.backward()
            self.sam.second_step()
        else:
            self.adam.step()
        return float(loss.value), ce, cons


def fit(x: np.ndarray, y: np.ndarray, n_classes: int, mode: str, feat: np.ndarray | None, seed: Sequence[int], epochs: int, settings: Settings = DEFAULTS) -> tuple[Network, list[tuple[float, float, float]]]:
    """A trained network and its mean losses by epoch, from arrays; a split smaller than a batch is one batch."""
    if mode in ("fic", "sam_fic") and feat is None:
        raise ValueError(f"mode {mode} needs features")
    if not len(x):
        raise ValueError("no windows to train on")
    rng = np.random.default_rng(seed)
    net = Network(x.shape[2], n_classes, feat.shape[1] if feat is not None else 0, rng)
    steps, size, losses = Steps(net, class_weights(y, n_classes), mode, settings), min(settings.batch, len(x)), []
    for _ in range(epochs):
        order, sums = rng.permutation(len(x)), []
        for b in range(len(x) // size):
            at = order[b * size : (b + 1) * size]
            sums.append(steps.step(x[at], y[at], feat[at] if feat is not None else None))
        losses.append(tuple(np.mean(sums, axis=0)))
    return net, losses


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _windows(rows: pd.Series) -> np.ndarray:
    return np.stack([np.stack(w).T for w in rows]).astype(np.float64)


def _network(saved: dict[str, np.ndarray]) -> Network:
    """The network of a state or model, as it was packed."""
    net = Network(saved["p_conv0"].shape[1], saved["p_out"].shape[1], len(saved["keep"]), np.random.default_rng(0), dtype=np.float32)
    for k, p in net.p.items():
        p.value = saved[f"p_{k}"]
    net.running = {k: (saved[f"m_{k}"], saved[f"v_{k}"]) for k in net.running}
    return net


def _arrays(net: Network) -> dict[str, np.ndarray]:
    return {f"p_{k}": v.value for k, v in net.p.items()} | {f"m_{k}": v[0] for k, v in net.running.items()} | {f"v_{k}": v[1] for k, v in net.running.items()}


class Fit:
    """A fit between two chunks: what standardises its rows, its network and its optimizer."""

    def __init__(self, state: bytes, mode: str, settings: Settings):
        self.saved = dict(np.load(io.BytesIO(state)))
        self.seed, self.fold = self.saved["of"].tolist()
        self.steps = Steps(_network(self.saved), self.saved["weight"], mode, settings)
        adam = self.steps.adam
        adam.t = int(self.saved["t"])
        if adam.t:
            adam.m, adam.v = ({k: self.saved[f"{at}_{k}"] for k in adam.m} for at in ("first", "second"))

    def step(self, x: np.ndarray, y: np.ndarray, feat: np.ndarray, at: Sequence[int]) -> None:
        """One batch of rows as they were read; ``at`` seeds its dropout, so a step doesn't depend on its chunk."""
        self.steps.net.rng = np.random.default_rng((self.seed, self.fold, *at))
        self.steps.step(_scaled(self.saved, x), y, _chosen(self.saved, feat))

    def packed(self) -> bytes:
        adam = self.steps.adam
        own = {k: self.saved[k] for k in ("of", "mu", "sd", "keep", "fmu", "fsd", "weight")}
        return _pack(**own, t=adam.t, **_arrays(self.steps.net), **{f"first_{k}": v for k, v in adam.m.items()}, **{f"second_{k}": v for k, v in adam.v.items()})


def _scaled(saved: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    return ((x.reshape(len(x), -1) - saved["mu"]) / saved["sd"]).reshape(x.shape).astype(np.float32)


def _chosen(saved: dict[str, np.ndarray], feat: np.ndarray) -> np.ndarray | None:
    return ((feat[:, saved["keep"]] - saved["fmu"]) / saved["fsd"]).astype(np.float32) if len(saved["keep"]) else None


def _start(own: pd.DataFrame, seed: int, fold: int, mode: str, settings: Settings) -> bytes:
    """The state before the first step, from the moments of all other folds (a row each)."""
    n = own.n.to_numpy()[:, None]
    means, total = np.stack(own["mean"]), n.sum()
    mu = (n * means).sum(0) / total
    var = (n * (np.stack(own["var"]) + (means - mu) ** 2)).sum(0) / total
    # a constant's variance is 0 but for rounding
    sd = np.where(var <= total * np.finfo(float).eps * var + (total * mu * np.finfo(float).eps) ** 2, 1.0, np.sqrt(var))
    channels = int(own.channels.iloc[0])
    mu, sd = (v.reshape(channels, -1).T.ravel() for v in (mu, sd))
    keep, fmu, fsd = np.zeros(0, int), np.zeros(0), np.zeros(0)
    if mode in ("fic", "sam_fic"):
        m = reduce(add, [moments.Moments(k, f, np.reshape(m2, (len(f), -1))) for k, f, m2 in zip(own.n, own.fmean, own.fm2, strict=True)])
        kept, deviations = moments.greedy(m, settings.var_threshold, settings.corr_threshold)
        keep = np.array(kept, int)
        fmu, fsd = m.mean[keep], deviations[keep]
    counts = np.stack(own.counts).sum(0)
    net = Network(channels, len(counts), len(keep), np.random.default_rng((seed, fold)), dtype=np.float32)
    return _pack(of=np.array([seed, fold]), mu=mu, sd=sd, keep=keep, fmu=fmu, fsd=fsd, weight=_weights(counts), t=0, **_arrays(net))


def _predict(model: bytes, rows: pd.DataFrame, labels: list[str], batch: int) -> list[str]:
    saved = dict(np.load(io.BytesIO(model)))
    net, out = _network(saved), []
    for a in range(0, len(rows), batch):
        part = rows.iloc[a : a + batch]
        found = net.forward(_scaled(saved, _windows(part.x)), _chosen(saved, np.stack(part.feat)))[0]
        out += [labels[i] for i in found.value.argmax(axis=1)]
    return out


def stand_in_windows(windows: DataFrame) -> DataFrame:
    """window_id, subj, y, x, feat of windows with subj, y and widx."""
    return features.extract(windows).select(F.xxhash64("subj", "y", "widx").alias("window_id"), "subj", "y", "x", "feat")


def training_sample(folded: DataFrame, max_train: int) -> DataFrame:
    """The ``max_train`` windows with the least hash (``__hash``, then window_id), all if fewer: for callers of fit_predict that ask for a bound.

    Counts by the first DIGITS of the hash (4,096 at most) tell how far to look, so only about ``max_train`` rows are
    sorted; the driver sees counts alone.
    """
    rows = hashed(folded)
    digits = F.substring(F.md5(F.col("window_id").cast("string")), 1, DIGITS)
    found = sorted(folded.select(digits.alias("digits")).groupBy("digits").count().collect())
    upto = np.searchsorted(np.cumsum([r["count"] for r in found]), max_train)
    if upto < len(found):  # the least hashes are among these
        rows = rows.filter(F.substring("__hash", 1, DIGITS) <= found[upto].digits).orderBy("__hash", "window_id").limit(max_train)
    return written(rows, "training-sample")


def hashed(folded: DataFrame) -> DataFrame:
    return folded.select("y", "x", "feat", "fold", "window_id", F.md5(F.col("window_id").cast("string")).alias("__hash"))


def first_states(rows: DataFrame, plan: DataFrame, labels: Sequence[str], mode: str, settings: Settings = DEFAULTS) -> DataFrame:
    """slot and state of each fit of ``plan`` before its first step.

    Each fold's counts and moments are one row of fixed size; a fit merges those of the other folds.
    """
    size = F.array(*[F.count_if(F.col("y") == v) for v in labels])
    own = rows.groupBy("fold").agg(F.count("*").alias("n"), size.alias("counts"), F.max(F.size("x")).alias("channels"))
    each = rows.select("fold", F.posexplode(F.flatten("x")).alias("pos", "v")).groupBy("fold", "pos").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    spread = each.groupBy("fold").agg(F.sort_array(F.collect_list(F.struct("pos", "mean", "var"))).alias("s")).select("fold", "s.mean", "s.var")
    own = own.join(spread, "fold")
    if mode in ("fic", "sam_fic"):
        own = own.join(moments.moments(rows, "fold", "feat").select("fold", F.col("mean").alias("fmean"), F.col("m2").alias("fm2")), "fold")
    own = written(own, "fold-moments")

    def start(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        return pd.DataFrame({"slot": [one.slot], "state": [_start(rows.sort_values("fold"), int(one.seed), int(one.own), mode, settings)]})

    pairs = own.join(F.broadcast(plan.select("slot", "seed", "own")), F.col("fold") != F.col("own"))
    return written(pairs.groupBy("slot").applyInPandas(start, "slot int, state binary"), "states")


def epoch_steps(rows: DataFrame, plan: DataFrame, epoch: int, batch: int) -> DataFrame:
    """slot, step, place and window_id, x, feat, label of every row in every full batch of an epoch, for each fit of ``plan``.

    ``rows`` are numbered with each fold's together, so a fit's rows are numbered by leaving a gap out.  Of n rows
    n % batch are left over, others in each epoch; fewer than a batch are one.
    """
    each = rows.join(F.broadcast(plan), F.col("fold") != F.col("own"))
    each = each.withColumn("row", F.col("row") - F.when(F.col("row") >= F.col("gap"), F.col("held")).otherwise(0))
    each = placed(each, "row", F.col("trains"), F.col("seed").cast("bigint"), F.lit(epoch), "place")
    size = F.least("trains", F.lit(batch))
    each = each.withColumn("step", F.floor(F.col("place") / size)).filter(F.col("step") < F.floor(F.col("trains") / size))
    return each.select("slot", "step", "place", "window_id", "x", "feat", "label")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by slot and step, a table for each."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.column_stack([b.column("slot").to_numpy(), b.column("step").to_numpy()])
        edges = [0, *(np.flatnonzero((np.diff(at, axis=0) != 0).any(1)) + 1).tolist(), len(at)]
        for i, j in zip(edges, edges[1:], strict=False):
            if held and tuple(at[i]) != now:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            now = tuple(at[i])
    if held:
        yield pa.Table.from_batches(held)


def _of(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks)


def train_chunk(states: DataFrame, steps: DataFrame, fits: int, epoch: int, mode: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``states`` (slot, state) after these steps: a task has a fit's state, then its batches as they come."""

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slot = None, None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([now.packed()], pa.binary())], ["slot", "state"])
        for t in _steps(batches):
            step = t.column("step")[0].as_py()
            if step < 0:  # the state
                if now is not None:
                    yield pack()
                now, slot = Fit(t.column("state")[0].as_py(), mode, settings), t.column("slot")[0].as_py()
            else:
                x = features.windows_array(_of(t, "x")).transpose(0, 2, 1)
                feat = _of(t, "feat").flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
                now.step(x, t.column("label").to_numpy(), feat, (epoch, step))
        if now is not None:
            yield pack()

    first = states.select("slot", F.lit(-1).cast("bigint").alias("step"), "state")
    rows = first.unionByName(steps, allowMissingColumns=True)
    dealt = rows.repartitionById(fits, F.col("slot")).sortWithinPartitions("slot", "step", "place")
    return dealt.select("slot", "step", "state", "x", "feat", "label").mapInArrow(go_on, "slot int, state binary")


def _models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """States without what only training needs."""
    for batch in batches:
        yield batch.assign(model=[_pack(**{k: v for k, v in np.load(io.BytesIO(s)).items() if not k.startswith(("first_", "second_"))}) for s in batch.state])[["slot", "model"]]


def trained(rows: DataFrame, fits: Sequence[tuple[int, int, int, int, int]], labels: Sequence[str], mode: str, epochs: int, settings: Settings = DEFAULTS) -> DataFrame:
    """seed, fold and model of every fit (seed, fold, first row behind the fold, its rows, rows to train on) after all epochs.

    ``rows`` are numbered by ``row`` with each fold's together.
    """
    names = F.array(*[F.lit(v) for v in labels])
    plan = rows.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(fits)], "slot int, seed int, own int, gap long, held long, trains long")
    states = first_states(rows, plan, labels, mode, settings)
    coded = rows.select("row", "fold", "window_id", "x", "feat", (F.array_position(names, F.col("y")) - 1).cast("int").alias("label"))
    count = max(n // min(n, settings.batch) for *_, n in fits)
    for epoch in range(epochs):
        steps = written(epoch_steps(coded, plan, epoch, settings.batch).withColumn("chunk", F.floor(F.col("step") / CHUNK)), "steps", "chunk")
        for chunk in range(-(-count // CHUNK)):
            before, states = states, written(train_chunk(states, steps.filter(F.col("chunk") == chunk).drop("chunk", "window_id"), len(fits), epoch, mode, settings), "states")
            forget(before)
        forget(steps)
    return states.mapInPandas(_models, "slot int, model binary").join(F.broadcast(plan), "slot").select("seed", F.col("own").alias("fold"), "model")


def fit_predict(folded: DataFrame, mode: str = "erm", seeds: Sequence[int] = (0,), epochs: int = DEFAULTS.epochs, settings: Settings = DEFAULTS, max_train: int | None = None) -> DataFrame:
    """seed, fold, window_id, y, p for every window of (window_id, subj, y, x, feat, fold) and seed.

    All windows outside a fold train its model, unless ``max_train`` asks for no more than so many windows in all.
    Raises ValueError without windows.
    """
    labels = sorted(r.y for r in folded.select("y").distinct().collect())
    if not labels:
        raise ValueError("no windows")
    rows = numbered(hashed(folded) if max_train is None else training_sample(folded, max_train), ("fold", "__hash", "window_id")).drop("n", "__hash")
    parts = {r.fold: (r.gap, r.held) for r in rows.groupBy("fold").agg(F.min("row").alias("gap"), F.count("*").alias("held")).collect()}  # a row a fold
    total = sum(held for _, held in parts.values())
    if max_train is None:
        folded = rows
    units = [(s, f.fold) for s in seeds for f in folded.select("fold").distinct().orderBy("fold").collect()]
    fits = [(s, f, gap, held, total - held) for s, f in units for gap, held in [parts.get(f, (0, 0))]]
    if any(n == 0 for *_, n in fits):
        raise ValueError("no windows to train on")
    models = trained(rows, fits, labels, mode, epochs, settings)
    rows = folded.select(F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), "fold", F.pmod(F.hash("window_id"), F.lit(SALTS)).alias("salt"), "window_id", F.col("y").cast("string").alias("y"), "x", "feat")

    def predict_group(rows: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame([], columns=["seed", "fold", "window_id", "y", "p"])
        return rows[["seed", "fold", "window_id", "y"]].assign(p=_predict(models.model.iloc[0], rows, labels, settings.batch))

    if len(units) <= MODELS:
        fitted = folded.sparkSession.sparkContext.broadcast({(r.seed, r.fold): bytes(r.model) for r in models.collect()})

        def predict_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for (s, f), part in batch.groupby(["seed", "fold"]):
                    yield predict_group(part, pd.DataFrame({"model": [fitted.value[int(s), int(f)]]}))

        return rows.mapInPandas(predict_batch, "seed int, fold int, window_id long, y string, p string")

    keys = ("seed", "fold", "salt")
    models = models.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.groupBy(*keys).cogroup(models.groupBy(*keys)).applyInPandas(predict_group, "seed int, fold int, window_id long, y string, p string")
