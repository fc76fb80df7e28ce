"""Connected components of a graph of links, without the graph on any one machine.

Large-star and small-star steps in turn (Kiveris and others, 2014): each links
a node's neighbours to the smallest of them, until every component is a star
around its smallest node.  The number of rounds grows with the logarithm of
the longest path; every round's links are written to the shared folder, so the
plan stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.lineage import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links from a node's neighbours to its smallest neighbour (or itself)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    out = both.join(least, "a")
    if large:
        return out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(out.select("a", F.col("m").alias("b")))


def connected(
    links: DataFrame, one: str = "a", other: str = "b",
    store: Callable[[DataFrame], DataFrame] = cut, drop: Callable[[DataFrame], None] = lambda _: None,
) -> DataFrame:
    """(node, component) for each node of a link; the component is its smallest node.

    Nodes without links aren't in the result.  Null ends and loops are left out.
    `store` writes a round's links, `drop` deletes those that the next round replaces.
    """
    a, b = F.col(one), F.col(other)
    now, mark = store(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()), None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if (sums.n, sums.s) == mark or not sums.n:
            break
        mark = (sums.n, sums.s)
        large = _star(now, True).where("a <> b").distinct()
        # every link now runs from a larger node to a smaller one
        small = _star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        nxt = store(small.where("a <> b").distinct())
        drop(now)
        now = nxt
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
