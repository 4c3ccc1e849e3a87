"""Chance fill over time against dense arrays, and what crossover with repair leaves."""

from collections import Counter

import pytest

from skylattice.functions.grid import Constellation
from skylattice.operators import fill, sequences
from skylattice.plans import fill_plans

C = Constellation(5, 4)
LINKS = "ind_id int, src int, dst int, t_setup int, t_work int, t_end int"


def dense_fill(given, inds, setup, steps, seed):
    """The rule as it reads, on arrays of every port and step."""
    out = []
    for ind in inds:
        right, left = set(), set()
        for i, s, d, a, _, b in given:
            if i == ind:
                right |= {(s, t) for t in range(a, b + 1)}
                left |= {(d, t) for t in range(a, b + 1)}
        for x in range(C.planes - 1):
            places = [((ind * 7919 + s * 104729 + t * 1299709 + seed) * 48271 % 2147483647, s, t) for s in range(x * C.slots, (x + 1) * C.slots) for t in range(steps - setup)]
            for h, s, t in sorted(places):
                span = range(t, t + setup + 1)
                if any((s, k) in right for k in span):
                    continue
                y = s % C.slots
                near = [(x + 1) * C.slots + (y + d) % C.slots for d in (-1, 0, 1)] + ([(x + 2) * C.slots + y] if x + 2 < C.planes else [])
                open_ = [d for d in near if not any((d, k) in left for k in span)]
                if open_:
                    d = open_[h // 1000 % len(open_)]
                    right |= {(s, k) for k in span}
                    left |= {(d, k) for k in span}
                    out.append((ind, s, d, t, t + setup, t + setup))
    return sorted([*given, *out])


@pytest.mark.parametrize(("setup", "seed"), [(1, 0), (2, 5), (3, 17)])
def test_fill_equals_dense_arrays(spark, setup, seed):
    given = [(0, 0, 4, 0, setup, 9), (0, 5, 9, 3, 3 + setup, 20), (2, 1, 5, 7, 7 + setup, 12), (2, 8, 16, 0, setup, 29)]
    inds = spark.createDataFrame([(i,) for i in range(4)], "ind_id int")
    got = fill.filled_over_time(spark.createDataFrame(given, LINKS), inds, C, setup, 30, seed)
    assert sorted(map(tuple, got.collect())) == dense_fill(given, range(4), setup, 30, seed)
    assert sequences.violations(got, setup, 30).isEmpty()


def test_no_individuals_and_no_links(spark):
    none = spark.createDataFrame([], LINKS)
    one = spark.createDataFrame([(7,)], "ind_id int")
    assert fill.filled_over_time(none, one.where("false"), C, 2, 30).isEmpty()
    assert sorted(map(tuple, fill.filled_over_time(none, one, C, 2, 30).collect())) == dense_fill([], [7], 2, 30, 0)


def test_a_port_knows_when_it_is_busy():
    port = fill.BusyPort()
    port.take(5, 8)
    port.take(0, 1)
    assert [port.free(a, b) for a, b in ((2, 4), (1, 2), (4, 5), (8, 9), (9, 30), (6, 7), (0, 30))] == [True, False, False, False, True, False, False]


def test_populations_keep_every_port_to_one_link(spark):
    sf = "/root/testdata/sf0.001"
    children = fill_plans.crossover_repaired(spark, sf)
    for population in (fill_plans.filled(spark, sf), fill_plans.grown(spark, sf), children.select(*sequences.LINK)):
        assert sequences.violations(population, fill_plans.SETUP, fill_plans.T).isEmpty()
    repairs = Counter(r.repair for r in children.collect())
    assert all(repairs[k] for k in ("none", "rewritten", "cut", "re-homed"))


def test_repair_on_one_pair(spark):
    """A link of plane 1 takes node 12 from plane 2's links: one is cut, one goes, and both look for another home."""
    c = Constellation(5, 4)
    a = [(0, 4, 12, 10, 12, 15)]
    b = [(1, 8, 12, 0, 2, 11), (1, 9, 12, 12, 14, 23), (1, 8, 13, 13, 15, 18), (1, 0, 4, 0, 2, 23)]
    parents = spark.createDataFrame([(5, 0, 1, 1)], "child int, a int, b int, point int")
    got = sequences.crossover_repaired(parents, spark.createDataFrame(a + b, LINKS), spark, c, 2)
    assert sorted(tuple(r) for r in got.collect()) == sorted([(5, 4, 12, 10, 12, 15, "rewritten"), (5, 8, 12, 0, 2, 9, "cut"), (5, 8, 13, 13, 15, 18, "none"), (5, 9, 14, 12, 14, 23, "re-homed")])
