"""The sticky window as a scan over blocks against a loop, on long histories."""

import random

import pytest

from skylattice.functions.grid import Constellation
from skylattice.operators import visibility

C = Constellation(12, 4)


def loop(spans, width):
    out = []
    for gid in sorted({g for g, _ in spans}):
        left = None
        for step in sorted(s for g, s in spans if g == gid):
            lo, hi = spans[gid, step]
            moved = left is not None and left + width <= hi
            left = lo if left is None or moved else left
            out.append((gid, step, left, moved))
    return out


@pytest.mark.parametrize(("steps", "block", "width"), [(5, 64, 3), (200, 4, 3), (700, 3, 2), (90_000, 64, 4)])
def test_equals_a_loop(spark, steps, block, width):
    rng = random.Random(steps)
    spans, rows = {}, []
    for gid in range(3):
        for step in rng.sample(range(steps), k=min(steps, 30_000) * 9 // 10):
            a, b = rng.randrange(C.planes), rng.randrange(C.planes)
            spans[gid, step] = min(a, b), max(a, b)
            rows += [(step, gid, x * C.slots + rng.randrange(C.slots)) for x in (a, b)]
    got = visibility.sticky_windows(spark.createDataFrame(rows, "step int, gid int, sat_id int"), C, width, block)
    assert sorted(map(tuple, got.collect())) == loop(spans, width)


def test_no_steps(spark):
    assert visibility.sticky_windows(spark.createDataFrame([], "step int, gid int, sat_id int"), C).isEmpty()
