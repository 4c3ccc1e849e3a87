"""Conflicts of links while others are set up, decided one after the other in time.

What one decision clears is gone for those after it. Decisions touch each other only through ports: a link takes the right
port of its source and the left port of its target. Ports that links connect, at any step, form a component; components are
independent, so each is folded on its own, and a task streams through the steps of its components in order. It
holds the links of the last ``setup`` steps and no more, however long the history is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import links as link_ops
from skylattice.functions.grid import Constellation
from skylattice.sources.shared import written


def port_components(links: DataFrame) -> DataFrame:
    """``src, component`` of the right ports of ``links``: those that left ports connect have one component, its smallest source.

    Each round takes the least component over a source's targets, and then that component's own, until nothing changes;
    rounds are written to the shared folder.
    """
    edges = written(links.select("src", "dst").distinct())
    at = written(edges.select("src", F.col("src").alias("component")).distinct())
    while True:
        by_target = edges.join(at, "src").groupBy("dst").agg(F.min("component").alias("near"))
        least = edges.join(by_target, "dst").groupBy("src").agg(F.min("near").alias("near"))
        further = at.select(F.col("src").alias("near"), F.col("component").alias("far"))
        new = written(least.join(further, "near", "left").join(at, "src").select("src", F.least("near", "far").alias("new"), "component"))
        if new.where("new <> component").isEmpty():
            return at
        at = new.select("src", F.col("new").alias("component"))


class _Fold:
    """The ports of one component while time goes on: ``right[step][src]`` is ``(dst, inside)``, ``left[step][dst]`` the source."""

    def __init__(self, setup: int, start: int, end: int, free_targets: bool):
        self.setup, self.start, self.end, self.free_targets = setup, start, end, free_targets
        self.right: dict[int, dict[int, tuple[int, bool]]] = {}
        self.left: dict[int, dict[int, int]] = {}
        self.ahead: dict[int, list[int]] = {}  # sources without links at steps to come
        self.last: int | None = None

    def _clear(self, step: int, src: int) -> None:
        link = self.right.get(step, {}).pop(src, None)
        if link is not None:
            self.left[step].pop(link[0], None)

    def _before(self, src: int, step: int) -> None:
        for t in range(step, max(self.start, step - self.setup + 1) - 1, -1):
            self._clear(t, src)

    def _after(self, src: int, step: int, known: int) -> None:
        for t in range(step, min(self.end, step + self.setup)):
            if t <= known:
                self._clear(t, src)
            else:
                self.ahead.setdefault(t, []).append(src)

    def _decide(self, src: int, step: int, was: bool, is_: bool, late: int, other: int, since: int) -> None:
        """The old link gives way up to ``step``; if only it is inside a region, ``other`` has no link from ``since`` on."""
        if was and is_:
            return
        if was:
            self._after(other, since, late)
        else:
            self._before(src, step)

    def _transition(self, step: int) -> None:
        now, then = self.right.get(step, {}), self.right.get(step + 1, {})
        for src in sorted(now.keys() | then.keys()):
            old, new = now.get(src), then.get(src)
            if old and new:
                if old[0] != new[0]:
                    self._decide(src, step, old[1], new[1], step + 1, src, step)
            elif new:
                self._appears(src, step, new)
            elif old:
                taken = self.left[step].get(old[0]), self.left.get(step + 1, {}).get(old[0])
                if None not in taken and taken[0] != taken[1]:
                    was, is_ = self.right[step][taken[0]][1], then[taken[1]][1]
                    self._decide(src, step, was, is_, step + 1, taken[1], step + 1)

    def _appears(self, src: int, step: int, new: tuple[int, bool]) -> None:
        for t in range(step - 1, max(self.start, step - self.setup) - 1, -1):
            old = self.right.get(t, {}).get(src)
            if old:
                if old[0] == new[0]:
                    continue
                self._decide(src, step, old[1], new[1], step + 1, src, t)
                return
            if self.free_targets and (holder := self.left.get(t, {}).pop(new[0], None)) is not None:
                self.right[t].pop(holder, None)

    def step(self, step: int, rows: list[tuple[int, int, bool]]) -> Iterator[tuple]:
        """Takes the links of the next step that has some; gives those that nothing can change any more."""
        if self.last is not None and self.last < step - 1:
            self._transition(self.last)
        self.right[step] = {src: (dst, inside) for src, dst, inside in rows}
        self.left[step] = {dst: src for src, dst, _ in sorted(rows)}  # of several links to a target it knows the one of the greatest source
        for t in [t for t in self.ahead if t <= step]:
            for src in self.ahead.pop(t):
                if t == step:
                    self._clear(step, src)
        self.last = step
        if step > self.start:
            self._transition(step - 1)
        yield from self._finished(step - self.setup)

    def _finished(self, before: int) -> Iterator[tuple]:
        for t in sorted(t for t in self.right if t < before):
            for src, (dst, _) in self.right.pop(t).items():
                yield t, src, dst, "right"
            for dst, src in self.left.pop(t).items():
                yield t, src, dst, "left"

    def finish(self) -> Iterator[tuple]:
        if self.last is not None and self.last < self.end - 1:
            self._transition(self.last)
        yield from self._finished(self.end)


SIDES = pa.schema([("step", pa.int32()), ("src", pa.int32()), ("dst", pa.int32()), ("side", pa.string())])


def resolved_in_order(links: DataFrame, inside: DataFrame | None, setup: int, start: int, end: int, free_targets: bool = False) -> DataFrame:
    """``step, src, dst, side`` of the links ``step, src, dst`` of [start, end) that stay, as right ports know them and as left ports do.

    From each step to the next, sources are looked at in their order. A source's link changes; or one appears and the
    source had one to another node at most ``setup`` steps earlier; or one ends because its target's left port goes to another
    source. Of the old and the new link, if none or only the new one is inside a region, the source keeps none in the
    ``setup`` steps up to the present one. If only the old one is, the source of the new link has none in ``setup`` steps from
    the old link's last step on (where it took a target: from the next step on). If both are, nothing happens.
    With ``free_targets``, where a link appears and its source had none, the earlier links of its target go too, back to the
    source's own earlier link or by ``setup`` steps.

    ``inside`` are the rows ``id, region_id`` of nodes in regions, without it no link is inside. If a step has several links
    to one target, its left port knows that of the greatest source, and is free when that port's link, or any other of
    them, is cleared.
    """
    if inside is None:
        rows = links.select("step", "src", "dst", F.lit(False).alias("inside"))
    else:
        labels = inside.where("region_id <> -1").select("id", "region_id")
        a, b = labels.toDF("src", "ra"), labels.toDF("dst", "rb")
        rows = links.join(a, "src", "left").join(b, "dst", "left").select("step", "src", "dst", F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)).alias("inside"))
    rows = rows.where(F.col("dst").isNotNull() & F.col("step").between(start, end - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, fold, step, held = None, None, None, []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SIDES)], schema=SIDES)
            out.clear()
            return made

        for given in batches:
            for c, t, *link in zip(*(x.to_pylist() for x in given.columns)):
                if (c, t) != (component, step):
                    if held:
                        out.extend(fold.step(step, held))
                    if c != component:
                        if fold is not None:
                            out.extend(fold.finish())
                        component, fold = c, _Fold(setup, start, end, free_targets)
                    step, held = t, []
                held.append(tuple(link))
            if len(out) > 10_000:
                yield batch()
        if held:
            out.extend(fold.step(step, held))
            out.extend(fold.finish())
        if out:
            yield batch()

    dealt = rows.join(port_components(rows), "src").select("component", "step", "src", "dst", "inside")
    return dealt.repartition("component").sortWithinPartitions("component", "step", "src").mapInArrow(run, "step int, src int, dst int, side string")


def extended_in_order(kept: DataFrame, spark: SparkSession, c: Constellation, setup: int, start: int, end: int) -> DataFrame:
    """``step, src, dst`` by which links that end are kept up while both nodes idle, except in the ``setup`` steps before the next use.

    Of the links that end at one step those of smaller sources come first, and a node that an earlier one keeps busy takes no
    other. Only links that end at the same step can meet: a node that had a link at a later step was used before then. So
    steps are independent, and a step has one link a node at most.
    """
    gaps = link_ops.idle_gaps(link_ops.filled(kept, spark, c, start, end), setup, end)
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct("src", "dst", "last"))),
        F.array().cast("array<struct<src:int,dst:int,last:int>>"),
        lambda acc, g: F.when(F.exists(acc, lambda k: (k["src"] == g["src"]) | (k["dst"] == g["src"]) | (k["src"] == g["dst"]) | (k["dst"] == g["dst"])), acc).otherwise(F.array_append(acc, g)),
    )
    chosen = gaps.groupBy("step").agg(taken.alias("taken")).select("step", F.explode("taken").alias("g"))
    return chosen.select(F.explode(F.sequence(F.col("step") + 1, F.col("g.last"))).alias("step"), "g.src", "g.dst")
