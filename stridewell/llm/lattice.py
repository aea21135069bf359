"""Operator 11: how filters interact, whatever the order in which they are applied.

A filter that comes next after a subset of the others is an edge of the lattice of subsets: five filters
have 5 * 2 ** 4 = 80 edges.  A document is kept, removed or redundant (failing, but gone before) on an edge
by nothing but which filters it fails, so documents are counted by that first, in one aggregation with
partial sums, and at most 2 ** 5 counts for each part of the corpus go to the 80 edges.  An order of the
filters is a path of five edges; the 120 orders take their 600 steps from the edges by a join.

What a filter needs of a text is a function of that text alone, but for copies: a document is one if
a smaller id has the same text.  Texts are known by 128 bits; the least id of each text comes from an
aggregation with partial minima, so a text that a third of all documents share costs a row for each task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import forget, written
from .text import read_table

_SPACE = "[\\x20\\x09-\\x0D]+"
#: Filters that are told apart by text; ``E``, copies of a smaller id, comes beside them.
LETTERS = "ABCDE"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails: A under 200 words; B distinct words under half; C capitals over 3 %; D holds a symbol."""
    words = F.array_remove(F.split(text, _SPACE), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters that they fail, bit i of mask standing for letter i.

    ``filters`` has the conditions on the column ``text`` by letter; the letter after them is that of copies.
    A row counts as good or toxic if any label of its id says so.  A null id is no smaller one and has none.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    fails = text_filters(F.col("text")) if filters is None else filters
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    copy = 1 << len(fails)
    nameless = rows.filter("id is null").groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(0).cast("bigint").alias("good"), F.lit(0).cast("bigint").alias("toxic"))

    # what is equal in id, text and part becomes one row with a count
    own = rows.filter("id is not null").select("id", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(11), F.col("text")).alias("h2"), mask.alias("mask"))
    own = own.groupBy("id", "h1", "h2", "mask", "part").agg(F.count("*").alias("n"))
    marks = labels.filter("(quality = 1 or toxic = 1) and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("l_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    own = own.join(marks, F.col("id") == F.col("l_id"), "left").drop("l_id")
    own = own.groupBy("id", "h1", "h2", "mask", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("parts"))
    own = written(own, "judged")

    counts = lambda df, sign: df.select("good", "toxic", "mask", F.explode("parts").alias("p")).groupBy("p.part", "mask").agg(*[(sign * F.sum(x)).alias(name) for name, x in (("n", F.col("p.n")), ("good", F.when(F.col("good"), F.col("p.n")).otherwise(0)), ("toxic", F.when(F.col("toxic"), F.col("p.n")).otherwise(0)))])
    whole = counts(own, 1)
    first = own.groupBy("h1", "h2").agg(F.min_by(F.struct("mask", "good", "toxic", "parts"), "id").alias("f")).select("f.*")
    first = written(counts(first, 1), "first")
    # copies are all rows less the first of each text
    copies = whole.unionByName(first.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    every = first.unionByName(copies.withColumn("mask", F.col("mask").bitwiseOR(copy))).unionByName(nameless)
    out = written(every.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")]), "masks")
    forget(own, first)
    return out


def edges(masks: DataFrame, n: int = len(LETTERS)) -> DataFrame:
    """part, filter, before and counts of each edge: the filter ``filter`` (a bit's place) after the subset ``before``.

    kept and removed by the filter, redundant (failing it, gone before), good_lost, toxic_lost, and
    unique_fails, of the filter alone; zeros included.
    """
    lattice = masks.sparkSession.createDataFrame([(f, s) for f in range(n) for s in range(1 << n) if not s >> f & 1], "filter int, before int")
    # 80 rows beside each count: the lattice is fixed
    rows = masks.select("*", F.explode(F.array(*[F.lit(f) for f in range(n)])).alias("filter")).join(F.broadcast(lattice), "filter")
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    fails = F.expr("shiftright(mask, filter) & 1 = 1")
    alone = F.expr("mask = shiftleft(1, filter)")
    removed = ~gone & fails
    add = lambda when, c: F.sum(F.when(when, F.col(c)).otherwise(0))
    return rows.groupBy("part", "filter", "before").agg(
        add(~gone & ~fails, "n").alias("kept"),
        add(removed, "n").alias("removed"),
        add(gone & fails, "n").alias("redundant"),
        add(alone, "n").alias("unique_fails"),
        add(removed, "good").alias("good_lost"),
        add(removed, "toxic").alias("toxic_lost"),
    )


def steps(masks: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of its edge, for every order; ``shapley`` sums removed over all orders.

    A filter comes after a given subset of size s in s! * (n - 1 - s)! orders.
    """
    n = len(letters)
    paths = []
    for order in permutations(range(n)):
        before = 0
        for i, f in enumerate(order):
            paths.append(("".join(letters[x] for x in order), i + 1, f, before))
            before |= 1 << f
    of = edges(masks, n)
    weights = F.array(*[F.lit(factorial(s) * factorial(n - 1 - s)) for s in range(n)])
    shares = of.groupBy("part", "filter").agg(F.sum(F.col("removed") * weights[F.bit_count("before")]).alias("shapley"))
    walk = masks.sparkSession.createDataFrame(paths, "filter_order string, step int, filter int, before int")
    out = of.join(shares, ["part", "filter"]).join(F.broadcast(walk), ["filter", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, letters: Sequence[str] = LETTERS, part: str = "lang") -> DataFrame:
    """steps() of (doc_id, text, a column that names the part) under filters on the text and that of copies.

    Null texts are empty ones, a null part is the empty string.  Rows equal in id, text and part are counted
    each, and none makes another a copy, as none has a smaller id; rows of a null id are never copies nor
    have copies or labels; repeated labels count once.  Texts may be of any length; an empty table gives no rows,
    an empty table of labels zeros; other columns don't matter.
    """
    return steps(judged(docs, labels, filters, part), letters)


def op11_lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
