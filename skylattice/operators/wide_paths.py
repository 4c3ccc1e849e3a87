"""Hops and betweenness on graphs that are too large for a matrix, or for a task.

Two ways. *Source blocks*: a task searches from a few sources at once over the graph's edge list, so a graph has as many
tasks as blocks, and a task's memory is its edges and the blocks' nodes. *Frontiers*: distances, numbers of shortest
paths and dependencies are tables keyed by graph, source and node, and a round is a join with the edges on the node, so no
task holds a graph. Rounds are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skylattice.sources.shared import written

#: Sources that a task searches from at once.
BLOCK = 32


def _levels(edges: DataFrame, sources: DataFrame, targets: DataFrame | None) -> list[DataFrame]:
    """For each number of hops the rows ``topo, src, node, paths``: what is first reached by it, and by how many shortest paths.

    With ``targets`` (``topo, src, node``) the search ends once all of them are reached, or nothing new is.
    """
    levels = [written(sources.select("topo", "src", F.col("src").alias("node"), F.lit(1.0).alias("paths")).distinct())]
    missing = None if targets is None else written(targets.join(levels[0], ["topo", "src", "node"], "left_anti"))
    while missing is None or not missing.isEmpty():
        near = edges.select("topo", F.col("src").alias("node"), F.col("dst").alias("to"))
        step = levels[-1].join(near, ["topo", "node"]).groupBy("topo", "src", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
        known = reduce(DataFrame.unionByName, levels).select("topo", "src", "node")
        new = written(step.join(known, ["topo", "src", "node"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
        if missing is not None:
            missing = written(missing.join(new, ["topo", "src", "node"], "left_anti"))
    return levels


def hops_by_rounds(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``topo, src, dst, hops`` of the pairs ``topo, src, dst`` that a path joins."""
    edges = written(edges.select("topo", "src", "dst").distinct())
    wanted = written(pairs.select("topo", "src", F.col("dst").alias("node")).distinct())
    levels = _levels(edges, wanted.select("topo", "src"), wanted)
    found = reduce(DataFrame.unionByName, (x.select("topo", "src", "node", F.lit(h).alias("hops")) for h, x in enumerate(levels)))
    return wanted.join(found, ["topo", "src", "node"]).select("topo", "src", F.col("node").alias("dst"), "hops")


def _roles(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(written(ends.where(F.col("role") == r).select("topo", "node").distinct()) for r in ("source", "target"))


def betweenness_by_rounds(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``topo, node, score`` as ``paths.betweenness`` has it, of the nodes that a shortest path from a source to a target passes.

    Dependencies go back level by level: each node hands its own, and one if it is a target, to those before it on
    shortest paths, by their shares of its paths.
    """
    edges = written(edges.select("topo", "src", "dst").distinct())
    sources, targets = _roles(ends)
    starts = sources.select("topo", F.col("node").alias("src"))
    wanted = starts.join(targets, "topo")  # all pairs of a graph's sources and targets: they are what is asked for
    levels = _levels(edges, starts, wanted)
    back = edges.select("topo", F.col("src").alias("before"), F.col("dst").alias("node"))
    after, parts = None, []
    for level, earlier in zip(levels[:0:-1], levels[-2::-1]):
        own = level.join(targets.withColumn("hit", F.lit(1.0)), ["topo", "node"], "left")
        if after is not None:
            own = own.join(after, ["topo", "src", "node"], "left")
        have = F.coalesce("hit", F.lit(0.0)) + (F.coalesce("share", F.lit(0.0)) if after is not None else F.lit(0.0))
        per_path = own.select("topo", "src", "node", (have / F.col("paths")).alias("each")).where("each > 0")
        handed = per_path.join(back, ["topo", "node"]).groupBy("topo", "src", F.col("before").alias("node")).agg(F.sum("each").alias("each"))
        after = written(handed.join(earlier, ["topo", "src", "node"]).select("topo", "src", "node", (F.col("each") * F.col("paths")).alias("share")))
        parts.append(after)
    if not parts:
        return levels[0].select("topo", "node", F.lit(0.0).alias("score")).where("false")
    passed = reduce(DataFrame.unionByName, parts).where("src <> node").groupBy("topo", "node").agg(F.sum("share").alias("score"))
    return passed.join(sources.unionByName(targets).distinct(), ["topo", "node"], "left_anti").select("topo", "node", "score")


class _Graph:
    """A graph's edges, sorted by target, for searches from several sources at once."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, more: np.ndarray):
        self.ids = np.unique(np.concatenate([src, dst, more]))
        a, b = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        self.size = len(self.ids)
        self.to_dst, self.to_src = self._sorted(a, b), self._sorted(b, a)

    @staticmethod
    def _sorted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(b, kind="stable")
        ends, first = np.unique(b[order], return_index=True)
        return a[order], ends, first

    def push(self, values: np.ndarray, along: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The sum of each node's neighbours' values, for each row."""
        out = np.zeros_like(values)
        if len(along[0]):
            out[:, along[1]] = np.add.reduceat(values[:, along[0]], along[2], axis=1)
        return out

    def search(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hops (-1: no path) and numbers of shortest paths from each start to each node."""
        hops, paths = np.full((len(starts), self.size), -1, np.int32), np.zeros((len(starts), self.size))
        hops[np.arange(len(starts)), starts], paths[np.arange(len(starts)), starts] = 0, 1
        h = 0
        while True:
            flow = self.push(np.where(hops == h, paths, 0), self.to_dst)
            new = (flow > 0) & (hops < 0)
            if not new.any():
                return hops, paths
            h += 1
            hops[new], paths[new] = h, flow[new]

    def through(self, starts: np.ndarray, is_target: np.ndarray) -> np.ndarray:
        hops, paths = self.search(starts)
        share = np.zeros_like(paths)
        for h in range(hops.max(), 0, -1):
            each = np.where(hops == h, (share + is_target) / np.maximum(paths, 1), 0)
            before = hops == h - 1
            share[before] = (self.push(each, self.to_src) * paths)[before]
        share[np.arange(len(starts)), starts] = 0
        return share.sum(axis=0)


def _blocks(sources: DataFrame) -> DataFrame:
    """``topo, node, block``: a graph's sources, ``BLOCK`` of them in a block."""
    rank = F.row_number().over(Window.partitionBy("topo").orderBy("node")) - 1
    return sources.select("topo", "node").distinct().withColumn("block", F.floor(rank / BLOCK).cast("int"))


def betweenness_in_blocks(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``topo, node, score``: as ``paths.betweenness``, for all nodes that an edge or an end has, with a task a block of sources."""
    sources, targets = _roles(ends)
    blocks = written(_blocks(sources))
    keys = blocks.select("topo", "block").distinct()
    parts = keys.join(edges.select("topo", "src", "dst").distinct(), "topo")
    marked = blocks.select("topo", "block", "node", F.lit("source").alias("role")).unionByName(keys.join(targets, "topo").select("topo", "block", "node", F.lit("target").alias("role")))

    def run(key: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        graph = _Graph(e["src"].to_numpy(), e["dst"].to_numpy(), p["node"].to_numpy())
        starts, ends_ = (np.searchsorted(graph.ids, p["node"][p["role"] == r]) for r in ("source", "target"))
        is_target = np.zeros(graph.size)
        is_target[ends_] = 1
        return pd.DataFrame({"topo": key[0], "node": graph.ids.astype(np.int32), "score": graph.through(starts, is_target)})

    found = parts.groupBy("topo", "block").cogroup(marked.withColumnsRenamed({"topo": "of", "block": "part"}).groupBy("of", "part")).applyInPandas(run, "topo long, node int, score double")
    end = sources.unionByName(targets).distinct().withColumn("end", F.lit(True))
    total = found.groupBy("topo", "node").agg(F.sum("score").alias("score")).join(end, ["topo", "node"], "left")
    return total.select("topo", "node", F.when(F.col("end"), 0.0).otherwise(F.col("score")).alias("score"))
