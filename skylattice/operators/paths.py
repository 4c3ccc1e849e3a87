"""Hop distances on topologies that change over time, and scores made of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.sources.shared import written

UNREACHABLE = 30


def distinct_topologies(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``step, topo`` and the edges ``topo, src, dst`` of one step for each distinct edge set: equal snapshots are searched once."""
    marks = F.xxhash64("src", "dst").cast("decimal(38,0)")
    names = edges.groupBy("step").agg(F.count("*").alias("n"), F.sum(marks).alias("s"), F.sum(F.xxhash64("dst", "src", F.lit(7)).cast("decimal(38,0)")).alias("s2"))
    names = names.select("step", F.xxhash64("n", "s", "s2").alias("topo"))
    chosen = names.groupBy("topo").agg(F.min("step").alias("step"))
    return names, edges.join(chosen, "step").select("topo", "src", "dst")


def _search(key: tuple, edges: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Breadth-first search from all sources of one small graph at once, as products of a boolean matrix."""
    ids = np.unique(np.concatenate([edges["src"], edges["dst"], sources["src"]]))
    a = np.zeros((len(ids), len(ids)), dtype=np.float32)
    a[np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"])] = 1
    start = np.unique(sources["src"])
    front = np.zeros((len(start), len(ids)), dtype=bool)
    front[np.arange(len(start)), np.searchsorted(ids, start)] = True
    hops = np.where(front, 0, -1)
    h = 0
    while front.any():
        h += 1
        front = (front.astype(np.float32) @ a > 0) & (hops < 0)
        hops[front] = h
    s, d = np.nonzero(hops >= 0)
    return pd.DataFrame({"topo": key[0], "src": start[s], "dst": ids[d], "hops": hops[s, d]})


def hops_by_topology(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``topo, src, dst, hops`` from each source (``topo, src``) to all nodes it reaches; one small graph a group."""
    apart = sources.select(F.col("topo").alias("of"), "src").distinct()
    pairs = edges.groupBy("topo").cogroup(apart.groupBy("of"))
    return pairs.applyInPandas(_search, "topo long, src int, dst int, hops int")


def hops_by_frontier(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """The same as joins and anti-joins, one round a hop, for graphs that are too large for a group."""
    edges = written(edges.select("topo", "src", "dst"))
    reached = written(sources.select("topo", "src", F.col("src").alias("dst"), F.lit(0).alias("hops")).distinct())
    front, h = reached, 0
    while not front.isEmpty():
        h += 1
        step = front.select("topo", F.col("src").alias("source"), F.col("dst").alias("src")).join(edges, ["topo", "src"]).select("topo", F.col("source").alias("src"), "dst").distinct()
        front = written(step.join(reached, ["topo", "src", "dst"], "left_anti").withColumn("hops", F.lit(h)))
        reached = written(reached.unionByName(front))
    return reached


def pair_hops(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``step, src, dst, hops`` of the asked pairs ``step, src, dst``; null where no path leads."""
    names, graphs = distinct_topologies(edges)
    wanted = pairs.join(names, "step")
    found = hops_by_topology(graphs, wanted.select("topo", "src"))
    return wanted.join(found, ["topo", "src", "dst"], "left").select("step", "src", "dst", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.col("hops")).alias("hops"))


def region_pairs(groups: DataFrame, source: int, target: int) -> DataFrame:
    """Every source with every target of the same step."""
    a = groups.where(F.col("gid") == source).select("step", F.col("sat_id").alias("src"))
    b = groups.where(F.col("gid") == target).select("step", F.col("sat_id").alias("dst"))
    return a.join(b, "step")


def average_path(hops: DataFrame) -> DataFrame:
    """Mean over the pairs that a path joins, null if none."""
    return hops.groupBy("step").agg((F.sum("hops") / F.count("hops")).alias("avg_hops"), F.count("hops").alias("n_pairs"))


def snapshot_fitness(hops: DataFrame, keys: list[str], penalty: int = UNREACHABLE) -> DataFrame:
    """Mean over all pairs, where pairs without a path count ``penalty`` hops."""
    return hops.groupBy(*keys).agg((F.sum(F.coalesce("hops", F.lit(penalty))) / F.count("*")).alias("score"))


def individual_fitness(scores: DataFrame, first: int, last: int) -> DataFrame:
    """Sum of an individual's snapshot scores over the steps [first, last]."""
    return scores.where(F.col("step").between(first, last)).groupBy("ind_id").agg(F.sum("score").alias("total"))


def hop_histogram(hops: DataFrame) -> DataFrame:
    return hops.where("hops IS NOT NULL").groupBy("hops").agg(F.count("*").alias("n"))


def best(scores: DataFrame, key: str, score: str) -> DataFrame:
    """The key with the least score, the smallest of equals."""
    return scores.agg(F.min_by(key, F.struct(score, key)).alias(key), F.min(score).alias(score))


def _yen(graph: dict[int, dict[int, int]], source: int, target: int, k: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Loopless paths by cost and then by nodes: shortest deviations of the paths found so far."""
    import heapq

    def shortest(prefix: tuple[int, ...], banned: set[tuple[int, int]]) -> tuple[int, tuple[int, ...]] | None:
        heap, done = [(0, prefix[-1:])], set()
        while heap:
            cost, path = heapq.heappop(heap)
            node = path[-1]
            if node == target:
                return cost, prefix[:-1] + path
            if node in done:
                continue
            done.add(node)
            for near, c in graph.get(node, {}).items():
                if near not in done and near not in prefix and (node, near) not in banned:
                    heapq.heappush(heap, (cost + c, (*path, near)))
        return None

    def cost_of(path: tuple[int, ...]) -> int:
        return sum(graph[a][b] for a, b in zip(path, path[1:]))

    found: list[tuple[int, ...]] = []
    first = shortest((source,), set())
    waiting = {(first[0], first[1])} if first else set()
    while waiting and len(found) < k:
        cost, path = min(waiting)
        waiting.discard((cost, path))
        found.append(path)
        yield cost, path
        for i in range(len(path) - 1):
            prefix = path[: i + 1]
            banned = {(p[i], p[i + 1]) for p in found if len(p) > i + 1 and p[: i + 1] == prefix}
            if other := shortest(prefix, banned):
                waiting.add((cost_of(other[1]), other[1]))


def k_shortest_paths(edges: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``graph, src, dst, rank, cost, path`` of the ``k`` cheapest loopless paths of each pair ``graph, src, dst``.

    ``edges``: ``graph, u, v, cost``; of parallel edges the cheapest counts. Equal costs go by the nodes of the path.
    """

    def run(key: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        graph: dict[int, dict[int, int]] = {}
        for u, v, cost in zip(e["u"].tolist(), e["v"].tolist(), e["cost"].tolist()):
            own = graph.setdefault(u, {})
            own[v] = min(cost, own.get(v, cost))
        rows = [(key[0], s, t, n, cost, "-".join(map(str, path))) for s, t in zip(p["src"].tolist(), p["dst"].tolist()) for n, (cost, path) in enumerate(_yen(graph, s, t, k), 1)]
        return pd.DataFrame(rows, columns=["graph", "src", "dst", "rank", "cost", "path"])

    schema = "graph long, src int, dst int, rank int, cost long, path string"
    apart = pairs.withColumnRenamed("graph", "of") if "graph" in pairs.columns else pairs
    return edges.groupBy("graph").cogroup(apart.groupBy("of")).applyInPandas(run, schema)


def shortest_path_nodes(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``step, src, dst, hops, path`` of the asked pairs: the first by its nodes of all shortest paths; pairs without one have no row."""
    names, graphs = distinct_topologies(edges)
    wanted = pairs.join(names, "step")
    unit = graphs.select(F.col("topo").alias("graph"), F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("cost"))
    found = k_shortest_paths(unit, wanted.select(F.col("topo").alias("of"), "src", "dst").distinct(), 1)
    return wanted.join(found.withColumnRenamed("graph", "topo"), ["topo", "src", "dst"]).select("step", "src", "dst", F.col("cost").cast("int").alias("hops"), "path")


def betweenness(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """``topo, node, score``: shortest paths from sources to targets through each node, as shares of each pair's paths.

    ``ends``: ``topo, node, role`` with role ``source`` or ``target``. Unnormalised; sources and targets score 0.
    """

    def run(key: tuple, e: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([e["src"], e["dst"], p["node"]]))
        a = np.zeros((len(ids), len(ids)))
        a[np.searchsorted(ids, e["src"]), np.searchsorted(ids, e["dst"])] = 1
        sources, targets = (np.searchsorted(ids, np.unique(p["node"][p["role"] == r])) for r in ("source", "target"))
        score = np.zeros(len(ids))
        is_target = np.zeros(len(ids), dtype=bool)
        is_target[targets] = True
        for s in sources:
            paths, level = np.zeros(len(ids)), np.full(len(ids), -1)
            paths[s], level[s] = 1, 0
            layers = [level == 0]
            while layers[-1].any():
                flow = np.where(layers[-1], paths, 0) @ a
                new = (flow > 0) & (level < 0)
                paths[new], level[new] = flow[new], len(layers)
                layers.append(new)
            share = np.zeros(len(ids))
            for layer, next_ in zip(layers[-2::-1], layers[:0:-1]):
                per_path = np.where(next_, (share + is_target) / np.maximum(paths, 1), 0)
                share[layer] = (paths * (a @ per_path))[layer]
            share[s] = 0
            score += share
        score[sources] = score[targets] = 0
        return pd.DataFrame({"topo": key[0], "node": ids.astype(np.int32), "score": score})

    return edges.groupBy("topo").cogroup(ends.withColumnRenamed("topo", "of").groupBy("of")).applyInPandas(run, "topo long, node int, score double")
