"""Layers and losses of the networks as expressions on array columns (of doubles).

They run inside the scan's projection, without a shuffle; training uses the same formulas in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def conv1d(x: Column, kernel: Sequence[float], bias: float = 0.0) -> Column:
    """Cross-correlation with zeros beyond the ends, as long as x (for a kernel of odd length)."""
    half = len(kernel) // 2
    pad = _literal([0.0] * half)
    padded = F.concat(pad, x, pad) if half else x
    return F.transform(x, lambda _, i: dot(F.slice(padded, i + 1, F.lit(len(kernel))), _literal(kernel)) + F.lit(bias))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def maxpool(x: Column, width: int = 2) -> Column:
    """The largest of each complete stretch of ``width``; a rest is dropped."""
    n = F.floor(F.size(x) / width).cast("int")
    empty = F.array().cast("array<double>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_max(F.slice(x, k * width + 1, F.lit(width))))).otherwise(empty)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def softmax(x: Column) -> Column:
    raised = _bound(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return _bound(raised, lambda r: _bound(total(r), lambda s: F.transform(r, lambda v: v / s)))


def softmax_pool(scores: Column, values: Column) -> Column:
    """Values averaged with the softmax of their scores."""
    return dot(softmax(scores), values)


def attend(query: Column, keys: Column, values: Column, scale: float) -> Column:
    """One head of attention of one query over arrays of keys and values."""
    weights = softmax(F.transform(keys, lambda k: dot(query, k) / F.lit(scale)))
    return _bound(weights, lambda w: F.transform(F.sequence(F.lit(0), F.size(values[0]) - 1), lambda d: dot(w, F.transform(values, lambda v: v[d]))))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def consistency_loss(a: Column, b: Column) -> Column:
    """Aggregate: one less the mean cosine."""
    return 1.0 - F.avg(cosine(a, b))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Of one row: log of the summed exponentials less the logit of the label (from 0)."""
    top = F.array_max(logits)
    return F.log(total(F.transform(logits, lambda v: F.exp(v - top)))) + top - F.element_at(logits, (label + 1).cast("int"))


def weighted_mean(loss: Column, weight: Column) -> Column:
    """Aggregate: the weighted mean of a loss."""
    return F.sum(loss * weight) / F.sum(weight)


def combined_loss(ce: Column, consistency: Column, weight: float = 0.3) -> Column:
    return ce + F.lit(weight) * consistency


def sam_perturbed(weights: Column, grads: Column, rho: float = 0.05) -> Column:
    """Weights moved by rho along the gradient's direction."""
    if rho < 0:
        raise ValueError("rho must not be negative")
    scale = F.lit(rho) / (norm(grads) + F.lit(1e-12))
    return F.zip_with(weights, grads, lambda w, g: w + g * scale)


def argmax(x: Column) -> Column:
    """The first place of the largest value, from 0."""
    return F.array_position(x, F.array_max(x)) - 1
