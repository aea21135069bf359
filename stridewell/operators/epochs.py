"""The order of an epoch as arithmetic: a keyed bijection of 0 .. n - 1 gives each row its place.

No row is sorted, moved or sent to the driver: where row i stands in an epoch follows from i, n, a seed and
the epoch's number.  A place is a pair of digits (l, r) in bases a and b, a * b being n or a little more; four rounds
add to one digit a mix of the other, which can be undone, so pairs are permuted.  A pair beyond n goes through the
rounds again until it falls below n (cycle walking), which keeps it a bijection of 0 .. n - 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..shared import written

ROUNDS = 4
#: Pairs beyond n are fewer than a, the square root of n: up to n = 4,096 a walk ends within so many steps for certain,
#: and beyond it one of that length has a chance of 64 ** -64.
WALK = 64


def round_key(seed: int | Column, epoch: Column, k: int) -> Column:
    """A number below 2 ** 31 for each round of an epoch."""
    return (F.lit(seed) * 1000003 + epoch.cast("bigint") * 7919 + (k + 1) * 104729 + 12345) * 69069 % 2147483648


def _spread(x: Column, key: Column) -> Column:
    return (x % 1073741824 * 2654435761 + key) % 4294967296


def _folded(t: Column) -> Column:
    """A number below 2 ** 40 that depends on all bits of t."""
    return F.shiftright(t.bitwiseXOR(F.shiftright(t, 15)) * 40503, 8)


def _div(x: Column, y: Column) -> Column:
    return ((x - x % y) / y).cast("bigint")


def _walk(p: Column) -> Column:
    """Goes through the rounds until the place is below n; p has a, b, n, the keys and where to begin."""
    mixed = lambda x, k: F.transform(F.array(_spread(x, p[3 + k])), _folded)[0]

    def rounds(i: Column) -> Column:
        l, r = _div(i, p[1]), i % p[1]  # noqa: E741
        for k in range(ROUNDS):
            if k % 2 == 0:
                l = (l + mixed(r, k)) % p[0]  # noqa: E741
            else:
                r = (r + mixed(l, k)) % p[1]
        return l * p[1] + r

    end = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), p[3 + ROUNDS], lambda y, s: F.when((s > 0) & (y < p[2]), y).otherwise(rounds(y)))
    return F.transform(F.array(end), lambda x: F.when(x < p[2], x).otherwise(F.raise_error(F.lit("a walk did not end")).cast("bigint")))[0]


def placed(df: DataFrame, row: str, n: Column, seed: int | Column, epoch: Column, name: str = "place") -> DataFrame:
    """``df`` with where row ``row`` of 0 .. n - 1 stands in an epoch; n up to 2 ** 48.

    Once through the rounds is compiled arithmetic, a column for each step; the few rows that must walk on do so in an
    array function.
    """
    i, keys = F.col(row).cast("bigint"), [f"__k{k}" for k in range(ROUNDS)]
    out = df.withColumn("__n", n.cast("bigint")).withColumns({key: round_key(seed, epoch, k) for k, key in enumerate(keys)})
    out = out.withColumn("__a", F.ceil(F.sqrt(F.col("__n").cast("double"))).cast("bigint"))
    out = out.withColumn("__b", _div(F.col("__n") + F.col("__a") - 1, F.col("__a")))
    out = out.withColumns({"__l": _div(i, F.col("__b")), "__r": i % F.col("__b")})
    for k, key in enumerate(keys):
        x, y, base = ("__r", "__l", "__a") if k % 2 == 0 else ("__l", "__r", "__b")
        out = out.withColumn("__t", _spread(F.col(x), F.col(key)))
        out = out.withColumn(y, (F.col(y) + _folded(F.col("__t"))) % F.col(base))
    out = out.withColumn("__x", F.col("__l") * F.col("__b") + F.col("__r"))
    start = F.array("__a", "__b", "__n", *keys, i)
    out = out.withColumn("__place", F.when(F.col("__x") < F.col("__n"), F.col("__x")).otherwise(F.transform(F.array(start), _walk)[0]))
    return out.select(*df.columns, F.col("__place").alias(name))


def numbered(df: DataFrame, order: Sequence[str], name: str = "row") -> DataFrame:
    """``df`` with its place in the order, from 0, and ``n``, the number of rows; rows equal in ``order`` come in any order.

    Rows are sorted by range partitions; a place is that in the partition and the sizes of those before.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # written, as a second run could draw other bounds
    ordered = written(ordered.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    parts = ordered.groupBy(part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # a row for each partition
    every = Window.orderBy("__part")
    parts = parts.select("__part", "__first", (F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__base"), F.sum("__n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    out = ordered.join(F.broadcast(parts), part == F.col("__part"))
    return out.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__base")).alias(name), "n")


def epoch_batches(rows: DataFrame, epochs: int, seed: int = 0, batch: int = DEFAULTS.batch, row: str = "row") -> DataFrame:
    """``rows`` (numbered) for each epoch, with ``epoch`` and ``batch``: full batches alone, what is left over is left out.

    Fewer rows than a batch are one batch.
    """
    size = F.least(F.col("n"), F.lit(batch))
    each = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    each = placed(each, row, F.col("n"), seed, F.col("epoch"), "batch").withColumn("batch", _div(F.col("batch"), size))
    return each.filter(F.col("batch") < F.floor(F.col("n") / size))


def label_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """keys, run (from 0), the label, first (place of the run's first row in its series), size: runs of equal labels.

    Rows are sorted by range partitions, which part a long series too.  A row for each series and partition says how many
    runs begin in it and which label it ends with, so runs are numbered over the partitions, and one that goes on from one
    to the next is added up.  Null is a label, null keys are a series; ties in ``order`` are broken by the label.
    """
    k, o = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))]
    sort = [*k, *o, "label"]
    own = df.select(*[F.col(c).alias(a) for c, a in zip(keys, k, strict=True)], *[F.col(c).alias(a) for c, a in zip(order, o, strict=True)], F.col(label).alias("label"))
    # written, as a second run could draw other bounds
    rows = written(own.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("part", F.spark_partition_id()), "runs")
    inside = Window.partitionBy(*k, "part").orderBy(*o, "label")
    here = F.struct("label")
    before = F.lag(here).over(inside)
    rows = rows.select(*k, "part", "label", (F.row_number().over(inside) - 1).cast("bigint").alias("at"), (before.isNotNull() & ~before["label"].eqNullSafe(F.col("label"))).cast("bigint").alias("begins"))
    rows = rows.withColumn("local", F.sum("begins").over(Window.partitionBy(*k, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*k, "part", "local").agg(F.first("label").alias("label"), F.min("at").alias("at"), F.count("*").alias("size"))
    # from here on a row for each run of a partition
    parts = runs.groupBy(*k, "part").agg(F.min_by(here, "local").alias("head"), F.max_by(here, "local").alias("end"), F.count("*").alias("runs"), F.sum("size").alias("rows"))
    series = Window.partitionBy(*k).orderBy("part")
    joined = F.coalesce(F.lag("end").over(series)["label"].eqNullSafe(F.col("head.label")) & F.lag("end").over(series).isNotNull(), F.lit(False)).cast("bigint")
    parts = parts.withColumn("new", F.col("runs") - joined).withColumn("joined", joined)
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in k], F.col("part").alias("_part"), (F.sum("new").over(upto) - F.col("new") - F.col("joined")).alias("base"), (F.sum("rows").over(upto) - F.col("rows")).alias("start"))
    same = F.col("part") == F.col("_part")
    for c in k:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    whole = runs.join(parts, same).groupBy(*k, (F.col("base") + F.col("local")).alias("run")).agg(F.first("label").alias("label"), F.min(F.col("at") + F.col("start")).alias("first"), F.sum("size").alias("size"))
    return whole.select(*[F.col(a).alias(c) for c, a in zip(keys, k, strict=True)], "run", F.col("label").alias(label), "first", "size")
