"""Fixed charges: bounds never exceed the least charges, searches that end find them, and searches cut short say how far off they may be."""

import random

from skylattice.operators import fixed_charge, flow


def least(edges, source, sink, demand):
    """The least charges over all sets of edges that carry the demand."""
    best = None
    for chosen in range(1 << len(edges)):
        charge = sum(e[2] for i, e in enumerate(edges) if chosen >> i & 1)
        if best is None or charge < best:
            if flow.cheapest_flow([(u, v, 0, cap if chosen >> i & 1 else 0) for i, (u, v, _, cap) in enumerate(edges)], source, sink, demand)[0] == "Optimal":
                best = charge
    return best


def graphs(n, seed):
    draw = random.Random(seed)
    for _ in range(n):
        nodes = draw.randint(3, 5)
        edges = [(draw.randrange(nodes), draw.randrange(nodes), draw.randrange(8), draw.randint(1, 6)) for _ in range(draw.randint(3, 9))]
        yield edges, nodes - 1, draw.randint(1, 9)


def test_bounds_and_search_equal_brute_force():
    for edges, sink, demand in graphs(120, 1):
        want = least(edges, 0, sink, demand)
        found, left = fixed_charge.explored(edges, 0, sink, demand, ([], []), None, 10_000)
        assert (found[0] if found else None) == want and not left
        cuts, shares = fixed_charge.crossing_bound(edges, 0, sink, demand), fixed_charge.share_bound(edges, 0, sink, demand)[0]
        assert want is None or (cuts <= want and shares <= want)


def test_cuts_count_as_many_edges_as_the_demand_needs():
    edges = [(0, 1, 3, 5)] * 4 + [(1, 2, 2, 9)] * 2
    assert fixed_charge.crossing_bound(edges, 0, 2, 12) == 3 * 3 + 2 * 2
    assert fixed_charge.crossing_bound(edges, 0, 2, 21) is None


def grid(planes, slots, seed):
    draw = random.Random(seed)
    return [
        (x * slots + y, (x + dx) * slots + y + dy, 1 + draw.randint(0, 3), 20 + 10 * ((x * slots + y) % 3))
        for x in range(planes) for y in range(slots) for dx, dy in ((1, -1), (1, 0), (1, 1), (2, 0)) if x + dx < planes and 0 <= y + dy < slots
    ]


def test_rounds_close_the_gap(spark):
    listed = [(g, *e) for g in range(3) for e in grid(9, 7, g)] + [(3, 0, 1, 4, 10), (4, 0, 1, 4, 10)]
    edges = spark.createDataFrame(listed, "graph long, u int, v int, cost int, cap int")
    wanted = spark.createDataFrame([(g, 2, 59, 40) for g in range(3)] + [(3, 0, 1, 10), (4, 0, 1, 11)], "graph long, source int, sink int, demand int")
    short = {r.graph: r for r in fixed_charge.charged_flow(edges, wanted, steps=5, rounds=1).collect()}
    whole = {r.graph: r for r in fixed_charge.charged_flow(edges, wanted, steps=40).collect()}
    for g in range(3):
        assert whole[g].status == "Optimal" and whole[g].gap == 0
        assert short[g].lower_bound <= whole[g].total_charge <= short[g].total_charge and short[g].gap == short[g].total_charge - short[g].lower_bound
    assert any(short[g].status == "Feasible" and short[g].gap > 0 for g in range(3))
    assert (whole[3].status, whole[3].total_charge, whole[3].n_edges) == ("Optimal", 4, 1)
    assert (whole[4].status, whole[4].total_charge, whole[4].gap, whole[4].n_edges) == ("Infeasible", None, None, None)
    assert fixed_charge.charged_flow(edges.limit(0), wanted.limit(0)).count() == 0
