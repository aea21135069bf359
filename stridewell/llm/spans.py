"""Places of regular expressions in texts, in DataFrame functions alone and linear in the text.

Where a match begins follows from the lengths of what stands between matches (split) and of the
matches themselves (extract).  Sums along such an array are taken in blocks, each value once; every
array that is used more than once is bound once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a running sum or maximum that are taken at once.
BLOCK = 128
SPAN = "array<struct<start:bigint,rank:int,kind:string,stop:bigint>>"
_LONGS = "array<bigint>"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def no_spans() -> Column:
    return F.array().cast(SPAN)


def running(values: Column, op: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For an array of longs, op over what comes before each value (``zero`` before the first); op is a sum or a maximum.

    Blocks of values are taken each on its own, from the total of the blocks before, so no array grows by one
    value at a time beyond a block.
    """
    start = F.lit(zero).cast("bigint")

    def of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda k: F.aggregate(F.slice(v, k * BLOCK + 1, F.lit(BLOCK)), start, op))

        def with_totals(t: Column) -> Column:
            def one(k: Column) -> Column:
                some = F.slice(v, k * BLOCK + 1, F.lit(BLOCK))
                first = F.aggregate(F.slice(t, F.lit(1), k), start, op)
                steps = F.aggregate(some, F.array(first), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))
                return F.slice(steps, F.lit(1), F.size(some))

            return F.flatten(F.transform(blocks, one))

        return bound(totals, with_totals)

    return bound(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast(_LONGS)))


def plus(a: Column, b: Column) -> Column:
    return a + b


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def matches(text: Column, pattern: str, gate: Column, make: Callable[[Column, Column, Column, Column], Column], kind: str) -> Column:
    """An array of ``make(start, match, before, after)``, one for each match, leftmost and not overlapping.

    start is a code point; before and after are what stands between a match and its neighbours.  Texts that
    fail ``gate`` have none.  ``kind`` is the type of the array.
    """

    def of(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(found, lambda m, i: (F.length(gaps[i]) + F.length(m)).cast("bigint"))
            return bound(running(steps, plus), lambda at: F.transform(found, lambda m, i: make(at[i] + F.length(gaps[i]), m, gaps[i], gaps[i + 1])))

        return F.when(F.size(found) > 0, bound(F.split(text, pattern, -1), with_gaps)).otherwise(F.array().cast(kind))

    return F.when(gate, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)).otherwise(F.array().cast(kind))


def spans(text: Column, kind: str, rank: int, pattern: str, gate: Column, fits: Callable[[Column], Column] | None = None) -> Column:
    """The spans of one kind, those whose matched text ``fits``."""
    make = lambda start, m, before, after: F.struct(start.cast("bigint").alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + F.length(m)).cast("bigint").alias("stop"), (F.lit(True) if fits is None else fits(m)).alias("fits"))
    wide = SPAN.replace(",stop:bigint", ",stop:bigint,fits:boolean")
    found = matches(text, pattern, gate, make, wide)
    return F.transform(F.filter(found, lambda s: s["fits"]), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))


def joined(of: Column) -> Column:
    """kind:start:end of spans in order, with commas."""
    return F.array_join(F.transform(F.array_sort(of), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
