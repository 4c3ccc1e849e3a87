"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a``, ``b``, of one orderable type); root is the component's least node.

    Alternates the large-star and small-star steps: every node hands its larger, then its smaller neighbours to the
    least one, until nothing changes, which takes about as many rounds as the logarithm of the graph's diameter. Each
    round is written to the shared folder. Least neighbours are pre-aggregated and written before the first join, so it
    can split the rows of a node with very many links. All joins sort, as no side has a bound that a driver could broadcast.
    Self-links and repeated links do no harm; no links give no rows.
    """
    links = persisted(links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct())
    nodes = links
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = None
    while True:
        pairs = _both_ways(links)
        least = persisted(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = pairs.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        links = persisted(small.where("a <> b").distinct())
        if (now := _state(links)) == state:
            break
        state = now
    everyone = _both_ways(nodes).select(F.col("a").alias("node")).distinct()
    return everyone.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
