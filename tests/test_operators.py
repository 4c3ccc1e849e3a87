import itertools
import random
from collections import defaultdict, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skylattice.functions.grid import LARGE, SMALL, Constellation
from skylattice.operators import evolve, fixed_charge, flow, grid, links, paths, visibility
from skylattice.plans.path_plans import FLOW_GRAPH
from skylattice.sources import xml


def bfs(edges, start):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    hops, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b not in hops:
                hops[b] = hops[a] + 1
                queue.append(b)
    return hops


def random_graph(seed, n=12, m=20):
    rng = random.Random(seed)
    return {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}


def test_both_hop_searches_equal_plain_search(spark):
    graphs = {k: random_graph(k) for k in range(4)}
    edges = spark.createDataFrame([(k, a, b) for k, g in graphs.items() for a, b in g], "topo long, src int, dst int")
    sources = spark.createDataFrame([(k, s) for k in graphs for s in (0, 3, 5)], "topo long, src int")
    want = sorted((k, s, d, h) for k, g in graphs.items() for s in (0, 3, 5) for d, h in bfs(g, s).items())
    assert sorted(map(tuple, paths.hops_by_topology(edges, sources).collect())) == want
    assert sorted(map(tuple, paths.hops_by_frontier(edges, sources).select("topo", "src", "dst", "hops").collect())) == want


def test_betweenness_equals_path_counting(spark):
    edges = [(a, b) for a, b in random_graph(3, 9, 16) if a != b]
    edges = sorted({*edges, *((b, a) for a, b in edges)})
    sources, targets = [0, 1], [7, 8]
    score = defaultdict(float)
    for s, t in itertools.product(sources, targets):
        hops = bfs(edges, s)
        if t not in hops:
            continue
        ways, todo = [], [[s]]
        while todo:
            way = todo.pop()
            if way[-1] == t:
                ways.append(way)
            elif len(way) <= hops[t]:
                todo += [[*way, b] for a, b in edges if a == way[-1] and hops.get(b) == len(way)]
        for way in ways:
            for v in way[1:-1]:
                score[v] += 1 / len(ways)
    frame = spark.createDataFrame([(0, a, b) for a, b in edges], "topo long, src int, dst int")
    ends = spark.createDataFrame([(0, n, r) for r, ns in (("source", sources), ("target", targets)) for n in ns], "topo long, node int, role string")
    got = {r.node: r.score for r in paths.betweenness(frame, ends).collect()}
    for n in got:
        assert got[n] == pytest.approx(0 if n in (*sources, *targets) else score[n])


def brute_flow(edges, source, sink, demand):
    """Cheapest integer flow by going through all flows of a tiny graph."""
    best = None
    for f in itertools.product(*(range(cap + 1) for *_, cap in edges)):
        net = defaultdict(int)
        for (u, v, _, _), x in zip(edges, f):
            net[u] -= x
            net[v] += x
        if net[source] == -demand and net[sink] == demand and all(not x for n, x in net.items() if n not in (source, sink)):
            cost = sum(x * e[2] for x, e in zip(f, edges))
            charge = sum(e[2] for x, e in zip(f, edges) if x)
            best = (cost, charge) if best is None else (min(best[0], cost), min(best[1], charge))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(0, 5), st.integers(0, 2)), min_size=1, max_size=7), st.integers(1, 3))
def test_flows_equal_brute_force(edges, demand):
    edges = [e for e in edges if e[0] != e[1]] or [(0, 1, 1, 1)]
    want = brute_flow(edges, 0, 3, demand)
    status, flows = flow.cheapest_flow(edges, 0, 3, demand)
    found, left = fixed_charge.explored(edges, 0, 3, demand, ([], []), None, 10_000)
    assert not left
    if want is None:
        assert status == "Infeasible" and found is None
    else:
        assert (status, sum(f * e[2] for f, e in zip(flows, edges))) == ("Optimal", want[0])
        assert found[0] == want[1]


def test_super_nodes_carry_several_sources(spark):
    base = spark.createDataFrame([(*e,) for e in FLOW_GRAPH], "src int, dst int, cost int, cap int")
    extra = spark.createDataFrame([(12, 3, 15, 60), (12, 2, 19, 60), (10, 11, 0, 100), (8, 11, 21, 60), (9, 11, 16, 40)], "src int, dst int, cost int, cap int")
    both = grid.with_super_nodes(base.unionByName(extra), spark.createDataFrame([(0, 30), (12, 30)], "node int, demand int"), spark.createDataFrame([(10,), (11,)], "node int"))
    edges = both.select(F.lit(0).cast("long").alias("graph"), F.col("src").alias("u"), F.col("dst").alias("v"), "cost", "cap")
    got = flow.min_cost_flow(edges, spark.createDataFrame([(0, -1, -2, 60)], "graph long, source int, sink int, demand int")).collect()
    net = defaultdict(int)
    for r in got:
        net[r.u] -= r.flow
        net[r.v] += r.flow
        assert r.flow <= r.cap
    assert {r.status for r in got} == {"Optimal"} and net[-1] == -60 and net[-2] == 60 and not any(x for n, x in net.items() if n not in (-1, -2))
    short = flow.min_cost_flow(edges, spark.createDataFrame([(0, -1, -2, 61)], "graph long, source int, sink int, demand int")).collect()
    assert {r.status for r in short} == {"Infeasible"}


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 99)), min_size=1, max_size=20), st.lists(st.integers(0, 9), min_size=4, max_size=4))
def test_frames_are_inverse(spark, rows, shifts):
    table = spark.createDataFrame(rows, "step int, node int")
    offsets = spark.createDataFrame(list(enumerate(shifts)), "step int, offset int")
    there = visibility.to_frame(table, offsets, SMALL, "node")
    back = visibility.to_frame(there, offsets, SMALL, "node", raw=True)
    assert sorted(map(tuple, back.select("step", "node").collect())) == sorted(rows)


def brute_skeleton(member, src, dst, steps, setup):
    """The rule as stated, for one link: ``member[node]`` is the set of steps in the region."""
    both = sorted(member[src] & member[dst])
    runs = []
    for t in both:
        if runs and runs[-1][1] == t - 1:
            runs[-1][1] = t
        else:
            runs.append([t, t])
    kept, following = [], steps + 10**6
    for a, e in reversed(runs):
        est = max(a, 1)
        if est > e and a != e:
            est = 1
        reach = []
        for node in (src, dst):
            at = est
            if est in member[node]:
                while est - at < setup and at - 1 > 0 and at - 1 in member[node]:
                    at -= 1
            reach.append(at)
        begin, end = min(reach), min(e, following - 1)
        if end >= a and end - begin >= setup:
            kept.append((begin, begin + setup, end))
            following = begin
    return kept


def test_region_skeleton_equals_the_rule(spark):
    rng = random.Random(8)
    rows, want, c = [], [], Constellation(2, 30)
    for k in range(30):
        member = {k: set(), k + 30: set()}
        for node in member:
            t = 0
            while t < 24:
                n = rng.randint(1, 7)
                if rng.random() < 0.65:
                    member[node] |= set(range(t, min(24, t + n)))
                t += n
        rows += [(t, 0, node) for node, ts in member.items() for t in ts]
        want += [(k, k + 30, *x) for x in brute_skeleton(member, k, k + 30, 24, 2)]
    got = links.region_skeleton(spark.createDataFrame(rows, "step int, gid int, sat_id int"), c, 2)
    assert sorted((r.src, r.dst, r.t_setup, r.t_work, r.t_end) for r in got.collect()) == sorted(want)
    states = links.dense_states(links.life_cycle(got.select("src", "dst", "t_setup", "t_work", "t_end")), spark, c, 24)
    assert links.state_violations(states).count() == 0
    assert sorted((r.t, r.src) for r in links.working_edges(states).collect()) == sorted((r.t, r.src) for r in states.where("state = 2").collect())


def test_greedy_fill_is_maximal_and_keeps_ports_single(spark):
    start = evolve.population(spark, SMALL, 3).where("src % 4 = 0")
    got = [tuple(r) for r in evolve.greedy_fill(start, spark, SMALL).collect()]
    assert {tuple(r) for r in start.collect()} <= set(got)
    for ind in range(3):
        own = [(s, d) for i, s, d in got if i == ind]
        sources, targets = {s for s, _ in own}, {d for _, d in own}
        assert len(own) == len(sources) == len(targets)
        assert not [1 for r in grid.candidates(spark, SMALL).collect() if r.src not in sources and r.dst not in targets]


def test_children_have_single_ports(spark):
    pop = evolve.population(spark, SMALL, 4)
    mates = spark.createDataFrame([(0, 0, 1, 4), (1, 2, 3, 0), (2, 3, 0, 8)], "child int, a int, b int, point int")
    rows = [tuple(r) for r in evolve.crossover(mates, pop, SMALL).collect()]
    assert len({(i, s) for i, s, _ in rows}) == len({(i, d) for i, _, d in rows}) == len(rows)


def test_xml_vocabularies(spark, tmp_path):
    edges = [(1202, 14, 13), (1202, 14, 15), (1202, 14, 52), (1300, 16, 13), (1301, 16, 59)]
    xml.write_edges(spark.createDataFrame(edges, "step int, src int, dst int"), str(tmp_path / "e"))
    assert sorted(map(tuple, xml.read_edges(spark, str(tmp_path / "e")).collect())) == sorted(edges)
    (tmp_path / "v.xml").write_text('<root><time step="3"><stations><station id="1"><satellite id="12.0"/><satellite id="7"/></station><station id="2"/></stations></time><time step="4"><stations/></time></root>')
    assert sorted(map(tuple, xml.read_visibility(spark, str(tmp_path / "v.xml")).collect())) == [(3, 1, 7), (3, 1, 12)]
    (tmp_path / "n.xml").write_text('<Nodes><Node cordination="1,2,3" asc_nodes_flag="1" rightneighbor="(2, 2, 3)" leftneighbor="None" state="2" importance="0.5"/><Node cordination="(0, 0, -1)" asc_nodes_flag="False" rightneighbor="None" leftneighbor="None" state="-1"/></Nodes>')
    got = sorted(xml.read_nodes(spark, str(tmp_path / "n.xml")).collect(), key=lambda r: r.x)
    assert [(r.x, r.y, r.t, r.asc, r.state, r.importance, r.left) for r in got] == [(0, 0, -1, False, -1, -1.0, None), (1, 2, 3, True, 2, 0.5, None)]
    assert tuple(got[1].right) == (2, 2, 3)
    rows = spark.sql("SELECT 1 AS x, 2 AS y, 3 AS t, named_struct('x', 2, 'y', 2, 't', 3) AS right, CAST(NULL AS STRUCT<x: INT, y: INT, t: INT>) AS left, 4 AS region_id, 0 AS left_state, 2 AS right_state, 0.25D AS importance")
    xml.write_nodes(rows, str(tmp_path / "n3"), version=3)
    back = xml.read_nodes(spark, str(tmp_path / "n3"), version=3).select(*rows.columns).collect()
    assert back == rows.collect()


def test_large_grid_counts(spark):
    assert grid.grid_edges(spark, LARGE).count() == 17 * 36 * 3
    assert grid.ring_edges(spark, LARGE).count() == 648 * 2
    every = grid.bidirectional(grid.grid_edges(spark, LARGE).unionByName(grid.ring_edges(spark, LARGE))).withColumn("step", F.lit(0))
    pairs = spark.createDataFrame([(0, 0, 647), (0, 5, 5)], "step int, src int, dst int")
    assert sorted((r.src, r.hops) for r in paths.pair_hops(every, pairs).collect()) == [(0, 18), (5, 0)]


def test_every_rule_of_the_state_machine_is_checked(spark):
    lives = {1: [1, 2, 2, -1], 2: [0, 2, 1, 0], 3: [-1, 1, 0, 0], 4: [2, 0, 1, 2], 5: [-1, 2, -1, 1]}
    rows = [(t, src, s) for src, states in lives.items() for t, s in enumerate(states)]
    found = links.state_violations(spark.createDataFrame(rows, "t int, src int, state int")).collect()
    before, after = {-1: (-1, 2), 0: (-1, 2), 1: (0, 1), 2: (1, 2)}, {-1: (-1, 0), 0: (1,), 1: (1, 2), 2: (2, -1, 0)}
    want = []
    for src, states in lives.items():
        for t, s in enumerate(states):
            want += [(src, t, "wrong before")] * (t > 0 and states[t - 1] not in before[s])
            want += [(src, t, "wrong after")] * (t < 3 and states[t + 1] not in after[s])
            want += [(src, t, "being set up at the first step")] * (t == 0 and s == 1) + [(src, t, "begins at the last step")] * (t == 3 and s == 0)
    assert sorted((r.src, r.t, r.violation) for r in found) == sorted(want)
    assert {r.violation for r in found} == {"wrong before", "wrong after", "being set up at the first step", "begins at the last step"}


def test_topology_flows_are_conserved(spark):
    from skylattice.plans.registry import QUERIES

    found = QUERIES["topology_flow"](spark, "/root/testdata/sf0.001").collect()
    members = {}
    for r in QUERIES["group_visibility"](spark, "/root/testdata/sf0.001").collect():
        members.setdefault((r.step, r.gid), set()).add(r.sat_id)
    graphs = {r.graph for r in found}
    assert len(graphs) >= 23
    for g in graphs:
        balance, flow_of = defaultdict(int), [r for r in found if r.graph == g and r.u is not None]
        for r in flow_of:
            assert r.u >= 0 and r.v >= 0 and 0 < r.flow <= r.cap
            balance[r.u] -= r.flow
            balance[r.v] += r.flow
        sources, sinks = members[g, 0], members[g, 4]
        assert all(n == 0 for node, n in balance.items() if node not in sources | sinks)
        assert all(balance[n] <= 0 for n in sources - sinks) and all(balance[n] >= 0 for n in sinks - sources)
        assert {r.status for r in found if r.graph == g} == {"Optimal"}
        away = -sum(balance[n] for n in sources - sinks)
        assert 0 <= away <= 10 * len(sources)


def test_fixed_charges_on_a_graph_of_more_than_64_edges(spark):
    edges = [(i, j, 1 + (i * 7 + j * 3) % 9, 10) for i in range(14) for j in range(i + 1, min(14, i + 8))]
    assert len(edges) > 64
    (charge, _), left = fixed_charge.explored(edges, 0, 13, 10, ([], []), None, 10_000)
    far = {0: 0}
    for i, j, cost, _ in edges:
        far[j] = min(far.get(j, 10**9), far[i] + cost)
    assert not left and charge == far[13]
