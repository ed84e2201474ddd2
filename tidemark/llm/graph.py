"""Connected components of links, in Spark (large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of the node and its neighbours."""
    both = _both_ways(links)
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of them (links run from larger to smaller)."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp) of every node in links (a, b); comp is its component's smallest node.

    Each round is checkpointed, so a lost executor costs one round.  A round ties every node
    nearer to its smallest; the links stop changing when all are tied to it directly.
    """
    now = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    print_of = lambda d: d.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    mark = print_of(now)
    for _ in range(most):
        if mark[0] == 0:
            break
        now = cut_lineage(_small_star(_large_star(now)))
        new = print_of(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")) \
        .union(now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct()
