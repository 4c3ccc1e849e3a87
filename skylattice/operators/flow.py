"""Cheapest flows on small graphs, one graph a group.

The graphs come from grouped tables, so Spark spreads them; the solvers are short helpers on a single graph.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.sources.shared import written


def priced_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int, demand: int) -> tuple[str, list[int], dict[int, int]]:
    """Status, flow on each edge ``(u, v, cost, capacity)``, and the nodes' potentials: cheapest augmenting paths.

    With ``cost + potential[u] - potential[v]`` as an edge's reduced cost, no edge with room left has a negative one and none
    with flow a positive one, which proves that no flow of this amount is cheaper.
    """
    at: dict[int, list[int]] = {}
    to, room, price = [], [], []
    for u, v, cost, cap in edges:
        for a, b, c, r in ((u, v, cost, cap), (v, u, -cost, 0)):
            at.setdefault(a, []).append(len(to))
            at.setdefault(b, [])
            to.append(b)
            room.append(r)
            price.append(c)
    potential = dict.fromkeys(at, 0)
    left = demand
    while left > 0 and source in at and sink in at:
        far, via, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in at[u]:
                v = to[e]
                step = d + price[e] + potential[u] - potential[v]
                if room[e] > 0 and step < far.get(v, float("inf")):
                    far[v], via[v] = step, e
                    heapq.heappush(heap, (step, v))
        if sink not in via:
            break
        most = max(far.values())
        for v in potential:
            potential[v] += far.get(v, most)
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        push = min(left, *(room[e] for e in path))
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
        left -= push
    return "Optimal" if left <= 0 else "Infeasible", [room[2 * i + 1] for i in range(len(edges))], potential


def cheapest_flow(edges: list[tuple[int, int, int, int]], source: int, sink: int, demand: int) -> tuple[str, list[int]]:
    """Status, and flow on each edge."""
    return priced_flow(edges, source, sink, demand)[:2]


def min_cost_flow(edges: DataFrame, demands: DataFrame) -> DataFrame:
    """``graph, status, u, v, cost, cap, flow`` of the edges that the cheapest flow uses.

    ``edges``: ``graph, u, v, cost, cap`` with costs of 0 or more; ``demands``: ``graph, source, sink, demand``. A demand
    that cannot be met gives its graph's greatest flow with status Infeasible; a graph without flow has one row of nulls.
    """

    def run(key: tuple, e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        rows = []
        listed = list(zip(*(e[c].tolist() for c in ("u", "v", "cost", "cap"))))
        for source, sink, demand in zip(d["source"].tolist(), d["sink"].tolist(), d["demand"].tolist()):
            status, flows = cheapest_flow(listed, source, sink, demand)
            used = [(key[0], status, *x, f) for x, f in zip(listed, flows) if f > 0]
            rows += used or [(key[0], status, None, None, None, None, None)]
        frame = pd.DataFrame(rows, columns=["graph", "status", "u", "v", "cost", "cap", "flow"])
        return frame.astype({c: "Int64" for c in ("u", "v", "cost", "cap", "flow")})

    schema = "graph long, status string, u long, v long, cost long, cap long, flow long"
    return edges.groupBy("graph").cogroup(demands.groupBy("graph")).applyInPandas(run, schema)


def flow_and_potentials(edges: DataFrame, demands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cheapest flow of each graph with what proves that it is the cheapest.

    ``edge, graph, u, v, cost, cap, flow`` of all edges (``edge`` tells parallel ones apart), ``graph, node, potential``, and
    ``graph, status``. Arguments as of ``min_cost_flow``, with one demand a graph.
    """

    def run(key: tuple, e: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        listed = sorted(zip(*(e[c].tolist() for c in ("u", "v", "cost", "cap"))))
        status, flows, potential = priced_flow(listed, *(int(d[c].iloc[0]) for c in ("source", "sink", "demand")))
        rows = [("edge", key[0], k, *x, f, None, None) for k, (x, f) in enumerate(zip(listed, flows))]
        rows += [("node", key[0], n, None, None, None, None, None, p, None) for n, p in potential.items()]
        rows.append(("status", key[0], None, None, None, None, None, None, None, status))
        frame = pd.DataFrame(rows, columns=["kind", "graph", "at", "u", "v", "cost", "cap", "flow", "potential", "status"])
        return frame.astype({c: "Int64" for c in frame.columns[2:9]})

    schema = "kind string, graph long, at long, u long, v long, cost long, cap long, flow long, potential long, status string"
    found = written(edges.groupBy("graph").cogroup(demands.groupBy("graph")).applyInPandas(run, schema))
    flows = found.where("kind = 'edge'").select(F.col("at").alias("edge"), "graph", "u", "v", "cost", "cap", "flow")
    return flows, found.where("kind = 'node'").select("graph", F.col("at").alias("node"), "potential"), found.where("kind = 'status'").select("graph", "status")


def certificate(flows: DataFrame, potentials: DataFrame, demands: DataFrame) -> DataFrame:
    """What is left to doubt in each graph's flow, as joins and sums: nothing, if all but ``demand``, ``shipped``, ``cost`` are 0.

    ``unbalanced`` nodes between source and sink, edges ``over`` capacity (or below zero), edges whose reduced ``price`` is wrong
    for their flow, and the ``gap`` between the flow's cost and the dual value of the potentials.
    """
    ends = demands.select("graph", "source", "sink", "demand")
    moved = flows.select("graph", F.explode(F.array(F.struct(F.col("u").alias("node"), (-F.col("flow")).alias("n")), F.struct(F.col("v").alias("node"), F.col("flow").alias("n")))).alias("m"))
    net = moved.groupBy("graph", F.col("m.node").alias("node")).agg(F.sum("m.n").alias("net")).join(ends, "graph")
    kept = net.groupBy("graph").agg(
        F.count_if((F.col("net") != 0) & (F.col("node") != F.col("source")) & (F.col("node") != F.col("sink"))).alias("unbalanced"), F.sum(F.when(F.col("node") == F.col("sink"), F.col("net"))).alias("shipped")
    )
    a, b = potentials.toDF("graph", "u", "at_u"), potentials.toDF("graph", "v", "at_v")
    priced = flows.join(a, ["graph", "u"]).join(b, ["graph", "v"]).withColumn("reduced", F.col("cost") + F.col("at_u") - F.col("at_v"))
    wrong = ((F.col("flow") < F.col("cap")) & (F.col("reduced") < 0)) | ((F.col("flow") > 0) & (F.col("reduced") > 0))
    sums = priced.groupBy("graph").agg(
        F.count_if((F.col("flow") < 0) | (F.col("flow") > F.col("cap"))).alias("over"),
        F.count_if(wrong).alias("price"),
        F.sum(F.col("flow") * F.col("cost")).alias("cost"),
        F.sum(F.col("cap") * F.least(F.col("reduced"), F.lit(0))).alias("slack"),
    )
    at = ends.join(potentials.toDF("graph", "source", "low"), ["graph", "source"]).join(potentials.toDF("graph", "sink", "high"), ["graph", "sink"])
    all_ = at.join(kept, "graph").join(sums, "graph")
    dual = F.col("shipped") * (F.col("high") - F.col("low")) + F.col("slack")
    return all_.select("graph", "demand", "shipped", "cost", "unbalanced", "over", "price", (F.col("cost") - dual).alias("gap"))


def flow_summary(flows: DataFrame) -> DataFrame:
    """Total cost of each graph's flow, and its status."""
    return flows.groupBy("graph", "status").agg(F.coalesce(F.sum(F.col("flow") * F.col("cost")), F.lit(0)).cast("long").alias("total_cost"))


def total_demand(sources: DataFrame, by: list[str]) -> DataFrame:
    """The sum of the sources' ``demand`` of each graph."""
    return sources.groupBy(*by).agg(F.sum("demand").cast("long").alias("demand"))


def without_super_nodes(flows: DataFrame, super_source: int = -1, super_sink: int = -2) -> DataFrame:
    """A flow's edges between real nodes."""
    return flows.where(f"u NOT IN ({super_source}, {super_sink}) AND v NOT IN ({super_source}, {super_sink})")
