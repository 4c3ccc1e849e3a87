"""Individuals with chance links over time: free ports are filled one after the other, in an order given by hashes.

Spark makes, deals and sorts the attempts; a task streams through those of one individual after another and knows its
busy ports as sorted intervals, so its memory grows with an individual's links and not with the steps.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylattice.functions.grid import Constellation, plane

#: Fixed values of a small arithmetic hash that other engines can compute as well.
FACTORS, MIX, MODULUS = (7919, 104729, 1299709), 48271, 2147483647


def mixed(a: Column, b: Column, c: Column, seed: int) -> Column:
    """A number from 0 to ``MODULUS`` - 1 that looks random."""
    terms = sum((x.cast("long") * f for x, f in zip((a, b, c), FACTORS)), F.lit(seed).cast("long"))
    return F.pmod(terms * MIX, F.lit(MODULUS))


class BusyPort:
    """When a port is in use: intervals that do not overlap, sorted."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def free(self, first: int, last: int) -> bool:
        k = bisect_right(self.spans, (last, 1 << 62))
        return k == 0 or self.spans[k - 1][1] < first

    def take(self, first: int, last: int) -> None:
        insort(self.spans, (first, last))


def candidates_of(src: int, planes: int, slots: int) -> list[int]:
    """The next plane's nodes at most one slot away, slots being a ring, and the node two planes on."""
    x, y = divmod(src, slots)
    near = [(x + 1) * slots + (y + d) % slots for d in (-1, 0, 1)] if x + 1 < planes else []
    return near + ([(x + 2) * slots + y] if x + 2 < planes else [])


NEW = pa.schema([(c, pa.int32()) for c in ("ind_id", "src", "dst", "t_setup", "t_work", "t_end")])


def filled_over_time(intervals: DataFrame, individuals: DataFrame, c: Constellation, setup: int, steps: int, seed: int = 0) -> DataFrame:
    """``intervals`` (``ind_id, src, dst, t_setup, t_work, t_end``) and the links that fill free ports of ``individuals`` (``ind_id``).

    Planes are filled from the first on, and in a plane every place ``src, t`` is tried once, in the order of its hash. A
    link is set up there if the source's right port is free from t to ``t + setup``, and to one of the candidates whose left
    port is, which the hash selects too. It works for one step; ``grown`` makes links last.
    """
    planes, slots = c.planes, c.slots
    given = intervals.select("ind_id", "src", "dst", F.col("t_setup").alias("t"), F.col("t_end").alias("end"), F.lit(-1).cast("long").alias("hash"))
    places = individuals.select("ind_id", F.explode(F.sequence(F.lit(0), F.lit((planes - 1) * slots - 1))).alias("src"))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - setup - 1))).alias("t"))
    tried = places.withColumn("hash", mixed(F.col("ind_id"), F.col("src"), F.col("t"), seed)).select("ind_id", "src", F.lit(None).cast("int").alias("dst"), "t", F.lit(None).cast("int").alias("end"), "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, right, left = None, {}, {}
        for batch in batches:
            out = []
            for ind, src, dst, t, end, hash_ in zip(*(batch.column(k).to_pylist() for k in ("ind_id", "src", "dst", "t", "end", "hash"))):
                if ind != current:
                    current, right, left = ind, {}, {}
                own = right.setdefault(src, BusyPort())
                if hash_ < 0:
                    own.take(t, end)
                    left.setdefault(dst, BusyPort()).take(t, end)
                elif own.free(t, t + setup):
                    open_ = [d for d in candidates_of(src, planes, slots) if left.setdefault(d, BusyPort()).free(t, t + setup)]
                    if open_:
                        dst = open_[hash_ // 1000 % len(open_)]
                        own.take(t, t + setup)
                        left[dst].take(t, t + setup)
                        out.append((ind, src, dst, t, t + setup, t + setup))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*out)], schema=NEW)

    order = F.when(F.col("hash") < 0, -1).otherwise(plane("src", c))  # links that are there come first
    dealt = given.unionByName(tried).withColumn("plane", order).repartition("ind_id").sortWithinPartitions("ind_id", "plane", "hash", "src", "t")
    made = dealt.mapInArrow(run, "ind_id int, src int, dst int, t_setup int, t_work int, t_end int")
    return intervals.select(*NEW.names).unionByName(made)
