"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import forget, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) for links (a, b) between longs.

    Each round takes the least root among a node and its neighbours, then the root's own root, so
    a path shrinks by half.  Links are small rows; a round is two joins on nodes and one
    aggregation with partial sums.  Its result is written, which cuts the lineage, and that of the
    round before is deleted.  Self links and repeated links do no harm; without links there are no rows.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct()
    both = written(both, "neighbours")
    roots = now = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "roots")
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("node").alias("other"), F.col("root").alias("r")), "other").groupBy("node").agg(F.min("r").alias("r"))
        new = roots.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        up = new.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = new.join(up, "root", "left").select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "was")
        new = written(new, "roots")
        forget(now)
        now, roots = new, new.select("node", "root")
        if new.filter("root < was").isEmpty():
            forget(both)
            return roots
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
