"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spandoc.llm.common import HEAVY, Space


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) with m of their a from ``least`` (a, m, n).

    A node with more than 1/HEAVY of ``total`` neighbours is no join key of one task: there are at most
    2 * HEAVY such nodes, and these are broadcast.
    """
    hot = F.col("n") * HEAVY > total
    first, rest = F.broadcast(least.filter(hot).drop("n")), least.filter(~hot).drop("n").hint("merge")
    return edges.join(first, "a").unionByName(edges.join(first.select("a"), "a", "left_anti").join(rest, "a"))


def components(edges: DataFrame, space: Space) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node it is linked with.

    Alternates large-star and small-star steps: every node hangs its larger, then its smaller
    neighbours on the smallest one it knows, until nothing changes.  Rounds grow with the
    logarithm of the number of nodes; each one is stored, so no lineage builds up.
    """
    now = space.write(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    total, mark = now.count(), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = space.write(
            _with_least(both, least, total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_least(large, least, total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = space.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        space.drop(now)
        space.drop(large)
        now = after
        if tuple(found) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        total, mark = found[0], tuple(found)
