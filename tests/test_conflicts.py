"""Sequential conflict resolution against a plain scan over the whole map of ports, and against simultaneous decisions."""

import random

import pytest

from skylattice.functions.grid import Constellation
from skylattice.operators import conflicts, links
from skylattice.plans import conflict_plans, link_plans
from skylattice.plans.registry import QUERIES

C = Constellation(6, 5)
STEPS, SETUP = 40, 3


def some_links(seed, steps=STEPS):
    """Links that come, change and go, some steps without any; targets are up to two planes ahead and may be wanted twice."""
    rng = random.Random(seed)
    right = {}
    out = []
    for t in range(steps):
        for src in range(25):
            if rng.random() < 0.12:
                right[src] = rng.choice([None, *(d for d in (src + 5, src + 6, src + 4, src + 10) if d < 30)])
        if t not in (17, 18, 19, 20, 21):
            out += [(t, src, dst) for src, dst in right.items() if dst is not None]
    return out


def scan(rows, region, free_targets):
    right, left = {}, {}
    for t, src, dst in sorted(rows):
        right[t, src], left[t, dst] = dst, src

    def inside(a, b):
        return region.get(a, -1) != -1 and region.get(a, -1) == region.get(b, -1)

    def clear(times, src):
        for t in times:
            dst = right.pop((t, src), None)
            if dst is not None:
                left.pop((t, dst), None)

    def decide(t, src, was, is_, other, since):
        if was and not is_:
            clear(range(since, min(STEPS, since + SETUP)), other)
        elif not was:
            clear(range(max(0, t - SETUP + 1), t + 1), src)

    for t in range(STEPS - 1):
        for src in range(25):
            old, new = right.get((t, src)), right.get((t + 1, src))
            if old is not None and new is not None and old != new:
                decide(t, src, inside(src, old), inside(src, new), src, t)
            elif old is None and new is not None:
                for b in range(t - 1, max(0, t - SETUP) - 1, -1):
                    earlier = right.get((b, src))
                    if earlier is not None:
                        if earlier == new:
                            continue
                        decide(t, src, inside(src, earlier), inside(src, new), src, b)
                        break
                    if free_targets and (b, new) in left:
                        right.pop((b, left.pop((b, new))), None)
            elif old is not None and new is None:
                a, b = left.get((t, old)), left.get((t + 1, old))
                if None not in (a, b) and a != b:
                    decide(t, src, inside(a, old), inside(b, old), b, t + 1)
    return right, left


def extend(right, left):
    right, left = dict(right), dict(left)
    for t in range(STEPS - 1):
        for src in range(25):
            dst = right.get((t, src))
            if dst is None or (t + 1, src) in right or (t + 1, src) in left:
                continue
            ahead = t + 1
            while ahead < STEPS and not any((ahead, n) in side for n in (src, dst) for side in (right, left)):
                ahead += 1
            for k in range(t + 1, ahead - SETUP):
                right[k, src], left[k, dst] = dst, src
    return right


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("free_targets", [False, True])
def test_equals_a_scan_over_the_whole_map(spark, seed, free_targets):
    rows, region = some_links(seed), {n: 1 for n in (1, 2, 6, 7, 11)} | {n: 2 for n in (13, 14, 18, 19, 23, 24)}
    links_ = spark.createDataFrame(rows, "step int, src int, dst int").repartition(5)
    regions = spark.createDataFrame([(n, region.get(n, -1)) for n in range(30)], "id int, region_id int") if seed % 2 else None
    got = {"right": set(), "left": set()}
    for r in conflicts.resolved_in_order(links_, regions, SETUP, 0, STEPS, free_targets).collect():
        got[r.side].add((r.step, r.src, r.dst))
    right, left = scan(rows, region if seed % 2 else {}, free_targets)
    assert got["right"] == {(t, s, d) for (t, s), d in right.items()} and got["left"] == {(t, s, d) for (t, d), s in left.items()}
    assert len(right) < len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_extension_in_order_equals_a_scan(spark, seed):
    rng = random.Random(seed)
    # one link a port, so that the scan's ports are those of the links
    rows, used = [], set()
    for t, src, dst in some_links(seed + 10):
        if rng.random() < 0.9 and (t, dst) not in used:
            used.add((t, dst))
            rows.append((t, src, dst))
    kept = spark.createDataFrame(rows, "step int, src int, dst int")
    got = {tuple(r) for r in conflicts.extended_in_order(kept, spark, C, SETUP, 0, STEPS).collect()}
    after = extend({(t, s): d for t, s, d in rows}, {(t, d): s for t, s, d in rows})
    assert got == {(t, s, d) for (t, s), d in after.items()} - set(rows) and got
    together = {tuple(r) for r in links.idle_extension(links.filled(kept, spark, C, 0, STEPS), SETUP, STEPS).collect()}
    assert got <= together


def test_order_matters_on_the_fixture(spark):
    sf = "/root/testdata/sf0.001"
    works = {(r.step, r.src, r.dst) for r in conflict_plans.resolve_in_order(spark, sf).where("kind = 'works'").collect()}
    together = {tuple(r) for r in link_plans.resolve_conflicts(spark, sf).collect()}
    assert works != together
    assert len(QUERIES["resolve_in_order_plain"](spark, sf).collect()) != len(QUERIES["resolve_conflicts_plain"](spark, sf).collect())


def test_components_are_ports_that_links_connect(spark):
    rows = [(0, 0, 10), (1, 1, 10), (2, 1, 11), (3, 2, 12), (4, 5, 12), (0, 7, 7)]
    got = {r.src: r.component for r in conflicts.port_components(spark.createDataFrame(rows, "step int, src int, dst int")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 5: 2, 7: 7}


def test_no_links(spark):
    none = spark.createDataFrame([], "step int, src int, dst int")
    assert conflicts.resolved_in_order(none, None, SETUP, 0, STEPS).count() == 0
    assert conflicts.extended_in_order(none, spark, C, SETUP, 0, STEPS).count() == 0
