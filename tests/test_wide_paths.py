"""Blocked and round-based searches against the dense ones, and the interval that reaches the scan."""

import random
from collections import deque

import pytest

from skylattice.operators import paths, wide_paths
from skylattice.plans import wide_plans  # noqa: F401  registers its queries
from skylattice.plans.registry import QUERIES


def graphs(seed, n=40, topologies=3):
    rng = random.Random(seed)
    edges = []
    for topo in range(topologies):
        for _ in range(n + 25 * topo):
            a, b = rng.sample(range(n), 2)
            edges += [(topo, a, b), (topo, b, a)]
    ends = [(topo, v, role) for topo in range(topologies) for role, k in (("source", 7), ("target", 9)) for v in rng.sample(range(n + 2), k)]
    return edges, ends


def hops_from(edges, topo, src):
    far, wait = {src: 0}, deque([src])
    while wait:
        u = wait.popleft()
        for t, a, b in edges:
            if (t, a) == (topo, u) and b not in far:
                far[b] = far[u] + 1
                wait.append(b)
    return far


@pytest.mark.parametrize("seed", range(2))
def test_three_ways_agree(spark, seed, monkeypatch):
    monkeypatch.setattr(wide_paths, "BLOCK", 3)
    edges, ends = graphs(seed)
    e, p = spark.createDataFrame(edges, "topo long, src int, dst int"), spark.createDataFrame(ends, "topo long, node int, role string")
    dense = {(r.topo, r.node): round(r.score, 9) for r in paths.betweenness(e.distinct(), p).collect()}
    blocked = {(r.topo, r.node): round(r.score, 9) for r in wide_paths.betweenness_in_blocks(e, p).collect()}
    rounds = {(r.topo, r.node): round(r.score, 9) for r in wide_paths.betweenness_by_rounds(e, p).collect()}
    assert blocked == dense and sum(dense.values()) > 0
    assert rounds == {k: v for k, v in dense.items() if v}
    pairs = [(t, s, d) for t, s, r in ends if r == "source" for u, d, q in ends if q == "target" and u == t]
    got = {(r.topo, r.src, r.dst): r.hops for r in wide_paths.hops_by_rounds(e, spark.createDataFrame(pairs, "topo long, src int, dst int")).collect()}
    want = {}
    for t, s, d in pairs:
        if (h := hops_from(edges, t, s).get(d)) is not None:
            want[t, s, d] = h
    assert got == want


def test_a_source_block_is_a_task_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(wide_paths, "BLOCK", 3)
    _, ends = graphs(5)
    sources = spark.createDataFrame(ends, "topo long, node int, role string").where("role = 'source'")
    sizes = [r["count"] for r in wide_paths._blocks(sources).groupBy("topo", "block").count().collect()]
    assert max(sizes) == 3 and len(sizes) == 9


def test_no_path_and_no_ends(spark):
    e = spark.createDataFrame([(0, 1, 2), (0, 2, 1), (0, 5, 6)], "topo long, src int, dst int")
    p = spark.createDataFrame([(0, 1, "source"), (0, 6, "target")], "topo long, node int, role string")
    assert {r.node: r.score for r in wide_paths.betweenness_in_blocks(e, p).collect()} == {1: 0, 2: 0, 5: 0, 6: 0}
    assert wide_paths.betweenness_by_rounds(e, p).isEmpty() and wide_paths.betweenness_by_rounds(e, p.where("false")).isEmpty()
    assert wide_paths.hops_by_rounds(e, spark.createDataFrame([(0, 1, 6), (0, 1, 1)], "topo long, src int, dst int")).collect() == [(0, 1, 1, 0)]


def test_the_interval_reaches_the_scan(spark):
    plan = QUERIES["interval_visibility"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint>" in plan
