"""Operator 3: toxicity from a character n-gram linear classifier.

A word is a run of characters between white space, in lower case with a mark at
either end; a text's features count its distinct words that hold a character
n-gram.  Each feature is scaled by its naive Bayes log-count ratio and a
logistic regression is trained on the scaled features.

Words are the only parts of a text that n-grams lie in, so a text's score is
the bias plus the sum over its distinct words of a word score, which a worker
computes once for each word.  The model is one weight for each hashed n-gram
(``2 ** BITS`` floats, whatever the corpus) and is broadcast.

Training takes at most ``max_train`` labelled rows, those with the smallest
hash of their id; the bound is a parameter, and it is the only bound here.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import PerPiece, blocks, id_and_text, mix, read_table, word_spans

BITS = 18
SIZES = (3, 4, 5)
#: Most labelled rows that a classifier is fitted on.
MAX_TRAIN = 8_000
ROUNDS = 60
SMOOTHING = 1.0
L2 = 1e-2
#: Bias without any labelled row: nothing is called toxic.
UNTAUGHT = -1.0
_WORDS = 1 << 16

_ARROW = pa.schema([("id", pa.int64()), ("score", pa.float64())])


def word_ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of n-grams of each word, their hashed ids joined)."""
    marked = [f"\x02{w.decode().lower()}\x03" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(size)), size)
    owner, ids = [], []
    for n in SIZES:
        if len(codes) < n:
            continue
        inside = np.flatnonzero(word[: len(codes) - n + 1] == word[n - 1 :])
        h = np.full(len(inside), n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(0x100000001B3) + codes[inside + k])
        owner.append(word[inside])
        ids.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    if not owner:
        return np.zeros(len(size), np.int64), np.zeros(0, np.int32)
    owner, ids = np.concatenate(owner), np.concatenate(ids)
    order = np.argsort(owner, kind="stable")
    return np.bincount(owner, minlength=len(size)), ids[order]


def _distinct_words(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, word row) of the distinct words of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.unique((doc << 32) | rows)
    return pair >> 32, pair & 0xFFFFFFFF


def fit(doc: np.ndarray, word: np.ndarray, at: np.ndarray, grams: np.ndarray, toxic: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weight of each hashed n-gram, bias) from (document, word) pairs, the n-grams of each word, and labels."""
    n, size = len(toxic), 1 << BITS
    prior = float(np.log((toxic.sum() + SMOOTHING) / (n - toxic.sum() + SMOOTHING))) if n else UNTAUGHT
    if n == 0 or toxic.all() or not toxic.any() or not len(doc):
        return np.zeros(size, np.float32), prior
    steps = range(0, len(at) - 1, _WORDS)  # n-grams of so many words at a time bound the memory

    def counts(of_docs: np.ndarray) -> np.ndarray:
        per_word = np.bincount(word, weights=of_docs[doc], minlength=len(at) - 1)
        total = np.zeros(size)
        for i in steps:
            edge = at[i : i + _WORDS + 1]
            total += np.bincount(grams[edge[0] : edge[-1]], weights=np.repeat(per_word[i : i + _WORDS], np.diff(edge)), minlength=size)
        return total

    def words(of_grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1)
        for i in steps:
            edge = at[i : i + _WORDS + 1]
            total = np.concatenate([[0.0], np.cumsum(of_grams[grams[edge[0] : edge[-1]]])])
            out[i : i + _WORDS] = np.diff(total[edge - edge[0]])
        return out

    p, q = SMOOTHING + counts(toxic.astype(float)), SMOOTHING + counts(1.0 - toxic)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    used = counts(np.ones(n)) > 0
    ratio[~used] = 0.0
    weight, bias, y = np.zeros(size), prior, toxic.astype(float)
    m1 = m2 = np.zeros(size)
    b1 = b2 = 0.0
    for t in range(1, rounds + 1):  # full-batch Adam
        z = bias + np.bincount(doc, weights=words(weight * ratio)[word], minlength=n)
        error = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y) / n
        grad = ratio * counts(error) + L2 * weight
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        b1, b2 = 0.9 * b1 + 0.1 * error.sum(), 0.99 * b2 + 0.01 * error.sum() ** 2
        step = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        weight = weight - step * m1 / (np.sqrt(m2) + 1e-8)
        bias = bias - step * b1 / (np.sqrt(b2) + 1e-8)
    return (weight * ratio).astype(np.float32), float(bias)


def _fit_task(batches: Iterator[pa.RecordBatch], rounds: int) -> Iterator[pa.RecordBatch]:
    store = PerPiece(word_ngrams, np.int32, most=1 << 62)
    docs, words, toxic, n = [], [], [], 0
    for batch, data, at in blocks(batches):
        start, end, first = word_spans(data, at)
        doc, word = _distinct_words(store.rows(data, start, end)[0], first)
        docs.append((doc + n).astype(np.int32))
        words.append(word.astype(np.int32))
        toxic.append(batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
        n += batch.num_rows
    if not n:
        docs, words, toxic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    weight, bias = fit(np.concatenate(docs), np.concatenate(words), store.at, store.values[0], np.concatenate(toxic), rounds)
    yield pa.RecordBatch.from_arrays([pa.array([weight.tobytes()]), pa.array([bias])], ["weight", "bias"])


def is_held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights of hashed n-grams and a bias, from labelled rows that are not held out.

    Rows without a label, an id or a text are left out; without both labels every weight is 0,
    and without any row the bias is UNTAUGHT.
    Of repeated labels of an id the largest counts.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna()
    known = known.filter(~is_held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    # at most max_train pairs of integers: small enough to broadcast
    texts = id_and_text(docs.filter(F.col(text_col).isNotNull()), id_col, text_col).join(F.broadcast(chosen), "id")
    rows = texts.select("id", "text", "toxic").repartition(1).mapInArrow(lambda it: _fit_task(it, rounds), "weight binary, bias double").collect()
    if not rows:  # a plan that is known to be empty runs no task
        return np.zeros(1 << BITS, np.float32), UNTAUGHT
    return np.frombuffer(bytes(rows[0].weight), np.float32), rows[0].bias


_STORES: dict[int, PerPiece] = {}


def _scorer(weights: np.ndarray, key: int, bias: float):
    """A function from the bytes and offsets of texts to their scores."""

    def word_scores(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n, grams = word_ngrams(words)
        owner = np.repeat(np.arange(len(n)), n)
        return np.ones(len(n), np.int64), np.bincount(owner, weights=weights[grams], minlength=len(n))

    if key not in _STORES:
        _STORES.clear()
        _STORES[key] = PerPiece(word_scores, np.float32)
    store = _STORES[key]
    store.compute = word_scores

    def scores(data: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, end, first = word_spans(data, at)
        row, place, values = store.rows(data, start, end)
        doc, word = _distinct_words(row, first)
        z = bias + np.bincount(doc, weights=values[place[word]], minlength=len(at) - 1)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))

    return scores


def score(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each text; null and empty texts get the score of the bias alone."""
    weight, bias = model
    shared, key = df.sparkSession.sparkContext.broadcast(weight), zlib.crc32(weight.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(shared.value, key, bias)
        for batch, data, at in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(data, at))], schema=_ARROW)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id long, score double")


def drop_toxic(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose text scores below the threshold, with all their columns."""
    weight, bias = model
    shared, key = df.sparkSession.sparkContext.broadcast(weight), zlib.crc32(weight.tobytes())

    @F.arrow_udf("double")
    def text_score(column: pa.Array) -> pa.Array:
        scores = _scorer(shared.value, key, bias)
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(scores(data, at) for _, data, at in blocks(iter([batch])))]))

    return df.filter(text_score(F.coalesce(F.col(text_col), F.lit(""))) < threshold)


def op3_ngram_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), is_held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
