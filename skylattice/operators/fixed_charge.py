"""Fixed charges on flows with a proven bound: the search tree is a table, whose open parts Spark deals to tasks round by round.

An edge costs its charge once, whatever flows on it. A row is a part of the tree (edges opened, edges closed) with a lower
bound on what any flow in it costs. A round takes every open part a number of steps further, merges the best flow of each
graph, and drops the parts whose bound is no better. What is left after the last round bounds the answer from below, so a
graph whose search did not end has a flow and a gap instead of a claim.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.operators.flow import cheapest_flow
from skylattice.sources.shared import written

SCALE = 1_000_000
Edges = list[tuple[int, int, int, int]]
_SCHEMA = "graph long, kind string, used array<int>, closed array<int>, bound long, charge long, flow array<int>"


def crossing_bound(edges: Edges, source: int, sink: int, demand: int) -> int | None:
    """Charges that any flow of ``demand`` pays, from cuts; None if a cut cannot carry it.

    With charges as lengths, the nodes nearer to the source than a radius are one side of a cut. At least as many edges
    as the widest ones needed for the demand cross it, and an edge is crossed by no more radii than its charge, so the
    sum over all radii of these least numbers is a bound.
    """
    out: dict[int, list[tuple[int, int]]] = {}
    for u, v, c, cap in edges:
        if cap > 0:
            out.setdefault(u, []).append((v, c))
    far, heap = {source: 0}, [(0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > far[u]:
            continue
        for v, c in out.get(u, ()):
            if d + c < far.get(v, d + c + 1):
                far[v] = d + c
                heapq.heappush(heap, (d + c, v))
    if sink not in far:
        return None
    end = far[sink]
    radii = sorted({d for d in far.values() if d <= end})
    total = 0
    for low, high in zip(radii, radii[1:]):
        caps = sorted((cap for u, v, _, cap in edges if cap > 0 and far.get(u, end) <= low and min(far.get(v, end), end) >= high), reverse=True)
        need = left = 0
        for cap in caps:
            if left >= demand:
                break
            left += cap
            need += 1
        if left < demand:
            return None
        total += need * (high - low)
    return total


def share_bound(edges: Edges, source: int, sink: int, demand: int) -> tuple[int | None, list[int]]:
    """Charges by the shares of the edges' capacities that the cheapest such flow takes, rounded up, and that flow; None if there is none."""
    priced = [(u, v, c * SCALE // max(1, min(cap, demand)), cap) for u, v, c, cap in edges]
    status, flow = cheapest_flow(priced, source, sink, demand)
    if status != "Optimal":
        return None, flow
    return -(-sum(f * x[2] for f, x in zip(flow, priced)) // SCALE), flow


def _charge(edges: Edges, flow: list[int]) -> int:
    return sum(e[2] for e, f in zip(edges, flow) if f > 0)


def mended(edges: Edges, source: int, sink: int, demand: int, flow: list[int], tries: int = 4) -> tuple[int, list[int]]:
    """A flow of no more charges: edges in use are priced by what flows on them, as long as that helps."""
    best = _charge(edges, flow), flow
    for _ in range(tries):
        priced = [(u, v, c * SCALE // (f or max(1, min(cap, demand))), cap) for (u, v, c, cap), f in zip(edges, best[1])]
        flow = cheapest_flow(priced, source, sink, demand)[1]
        if _charge(edges, flow) >= best[0]:
            break
        best = _charge(edges, flow), flow
    return best


def explored(edges: Edges, source: int, sink: int, demand: int, part: tuple[list[int], list[int]], least: int | None, steps: int) -> tuple[tuple[int, list[int]] | None, list[tuple[list[int], list[int], int]]]:
    """What ``steps`` steps into a part of the tree find: a flow cheaper than ``least``, and the parts left open with their bounds."""
    found, heap, ties = None, [(0, 0, part)], 0
    while heap and steps > 0:
        low, _, (used, closed) = heapq.heappop(heap)
        if least is not None and low >= least:
            continue
        steps -= 1
        free, shut = set(used), set(closed)
        view = [(u, v, 0 if i in free else c, 0 if i in shut else cap) for i, (u, v, c, cap) in enumerate(edges)]
        cuts = crossing_bound(view, source, sink, demand)
        shares, flow = share_bound(view, source, sink, demand) if cuts is not None else (None, [])
        if shares is None:
            continue
        paid = sum(edges[i][2] for i in used)
        low = max(low, paid + max(cuts, shares))
        open_edges = [(e[0], e[1], e[2], 0 if i in shut else e[3]) for i, e in enumerate(edges)]
        charge, better = mended(open_edges, source, sink, demand, flow)
        if least is None or charge < least:
            least, found = charge, (charge, better)
        undecided = [i for i, f in enumerate(flow) if f > 0 and i not in free and edges[i][2] > 0]
        if low >= least or not undecided:
            continue
        # the edge whose charge the shares count least of
        pick = max(undecided, key=lambda i: (edges[i][2] * (1 - flow[i] / max(1, min(edges[i][3], demand))), edges[i][2], -i))
        for child in ((used + [pick], closed), (used, closed + [pick])):
            ties += 1
            heapq.heappush(heap, (low, ties, child))
    return found, [(u, c, low) for low, _, (u, c) in heap if least is None or low < least]


def charged_flow(edges: DataFrame, demands: DataFrame, *, steps: int = 200, rounds: int = 20) -> DataFrame:
    """``graph, status, total_charge, lower_bound, gap, n_edges`` of the flow with the least sum of charges found.

    ``edges``: ``graph, u, v, cost, cap`` with charges of 0 or more in whole numbers; ``demands``: one row ``graph, source,
    sink, demand`` a graph. Status is Optimal if the gap is 0, Feasible if ``rounds`` rounds left one, and Infeasible (nulls)
    if the demand cannot be met. A graph must fit a task, its search tree need not: open parts are rows that are dealt anew
    each round, and the result does not depend on how.
    """
    spark = edges.sparkSession
    listed = edges.groupBy("graph").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("u", "v", "cost", "cap"))))).alias("edges"))
    graphs = written(demands.select("graph", "source", "sink", "demand").join(listed, "graph"))
    none = F.array().cast("array<int>")
    parts = graphs.select("graph", none.alias("used"), none.alias("closed"), F.lit(0).cast("long").alias("bound"))
    best = graphs.select("graph", F.lit(None).cast("long").alias("charge"), none.alias("flow"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                listing = [(int(e["u"]), int(e["v"]), int(e["cost"]), int(e["cap"])) for e in r.edges]
                least = None if pd.isna(r.charge) else int(r.charge)
                found, left = explored(listing, int(r.source), int(r.sink), int(r.demand), ([*map(int, r.used)], [*map(int, r.closed)]), least, steps)
                if found:
                    rows.append((r.graph, "best", None, None, None, found[0], found[1]))
                rows += [(r.graph, "open", used, closed, max(low, int(r.bound)), None, None) for used, closed, low in left]
            yield pd.DataFrame(rows, columns=["graph", "kind", "used", "closed", "bound", "charge", "flow"]).astype({"bound": "Int64", "charge": "Int64"})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(rounds):
        dealt = parts.join(graphs, "graph").join(best.select("graph", "charge"), "graph").repartition(tasks, F.xxhash64("graph", "used", "closed"))
        found = written(dealt.mapInPandas(run, _SCHEMA))
        seen = best.unionByName(found.where("kind = 'best'").select("graph", "charge", "flow"))
        best = written(seen.groupBy("graph").agg(F.min_by(F.struct("charge", "flow"), F.struct(F.col("charge").isNull(), "charge", "flow")).alias("b")).select("graph", "b.*"))
        left = found.where("kind = 'open'").select("graph", "used", "closed", "bound").join(best.select("graph", "charge"), "graph")
        parts = written(left.where("charge IS NULL OR bound < charge").drop("charge"))
        if parts.isEmpty():
            break
    low = parts.groupBy("graph").agg(F.min("bound").alias("open"))
    out = graphs.select("graph").join(best, "graph").join(low, "graph", "left")
    bound = F.coalesce("open", "charge")
    status = F.when(F.col("charge").isNull(), F.when(F.col("open").isNull(), "Infeasible").otherwise("Open")).when(F.col("open").isNull(), "Optimal").otherwise("Feasible")
    n = F.size(F.filter("flow", lambda f: f > 0))
    return out.select("graph", status.alias("status"), F.col("charge").alias("total_charge"), bound.alias("lower_bound"), (F.col("charge") - bound).alias("gap"), F.when(F.col("charge").isNotNull(), n).alias("n_edges"))
