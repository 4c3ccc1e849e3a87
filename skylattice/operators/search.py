"""A genetic search over populations of topology sequences of the surveyed size, which scores only what it has not seen.

A snapshot's score depends on its links and its step alone. So scores are kept by step and a mark of the links, in a
table that grows from generation to generation; only marks that it lacks are searched, once each. Individuals that stay, and
steps that an edit does not touch, cost a join.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.grid import Constellation
from skylattice.operators import evolve, grid, paths, sequences
from skylattice.sources.shared import written

LINK = sequences.LINK


def snapshot_marks(intervals: DataFrame, steps: list[int]) -> DataFrame:
    """``ind_id, step, mark``: a number for the links that work at each of ``steps``; equal links have equal marks."""
    alive = intervals.select("ind_id", "src", "dst", F.explode(F.sequence("t_work", "t_end")).alias("step"))
    sums = alive.groupBy("ind_id", "step").agg(F.count("*").alias("n"), *(F.sum(F.xxhash64("src", "dst", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in (0, 1)))
    every = intervals.select("ind_id").distinct().select("ind_id", F.explode(F.array(*map(F.lit, steps))).alias("step"))
    return every.join(sums, ["ind_id", "step"], "left").select("ind_id", "step", F.xxhash64(F.coalesce("n", F.lit(0)), "s0", "s1").alias("mark"))


def unseen_scores(intervals: DataFrame, marks: DataFrame, known: DataFrame | None, pairs: DataFrame, c: Constellation) -> DataFrame:
    """``step, mark, score`` of the marks that ``known`` (``step, mark, score``) lacks: mean hops of the step's pairs over links and rings."""
    new = marks if known is None else marks.join(known, ["step", "mark"], "left_anti")
    new = written(new)
    wanted = new.select("step", "mark").distinct()
    # one place where the links of a mark can be found
    found = new.groupBy("mark").agg(F.min(F.struct("ind_id", "step")).alias("at")).select("mark", "at.ind_id", F.col("at.step").alias("step"))
    spread = intervals.select("ind_id", "src", "dst", F.explode(F.sequence("t_work", "t_end")).alias("step"))
    links = found.join(spread, ["ind_id", "step"]).select(F.col("mark").alias("topo"), "src", "dst")
    rings = grid.ring_edges_at(found.select(F.col("mark").alias("topo")), c)
    edges = grid.bidirectional(links.unionByName(rings))
    asked = pairs.join(wanted, "step").withColumnRenamed("mark", "topo")
    hops = asked.join(paths.hops_by_topology(edges, asked.select("topo", "src")), ["topo", "src", "dst"], "left")
    hops = hops.withColumn("hops", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.col("hops")))
    return paths.snapshot_fitness(hops, ["step", "topo"]).withColumnRenamed("topo", "mark")


class Scores:
    """Scores of snapshots by step and mark, and how many were searched for."""

    def __init__(self, pairs: DataFrame, c: Constellation):
        self.pairs, self.c = written(pairs), c
        self.steps = sorted(r.step for r in self.pairs.select("step").distinct().collect())
        self.known: DataFrame | None = None
        self.searched: list[int] = []

    def of(self, intervals: DataFrame) -> DataFrame:
        """``ind_id, step, score`` of every individual."""
        marks = written(snapshot_marks(intervals, self.steps))
        new = written(unseen_scores(intervals, marks, self.known, self.pairs, self.c))
        self.searched.append(new.count())
        self.known = new if self.known is None else written(self.known.unionByName(new))
        return written(marks.join(self.known, ["step", "mark"]).select("ind_id", "step", "score"))


def chosen_pairs(size: int, rate: float, planes: int, rng: random.Random) -> list[tuple[int, int, int]]:
    """Neighbours among the individuals that are chosen with chance ``rate``, and the plane at which each pair is cut."""
    chosen = [i for i in range(size) if rng.random() < rate]
    return [(a, b, rng.randrange(planes - 1)) for a, b in zip(chosen[::2], chosen[1::2])]


def search_sequences(
    spark: SparkSession, start: DataFrame, size: int, pairs: DataFrame, weights: DataFrame, protected: DataFrame, c: Constellation, setup: int, steps: int, generations: int,
    crossover_rate: float = 0.15, mutation_rate: float = 0.3, seed: int = 0,
) -> tuple[DataFrame, DataFrame, list[int]]:
    """History ``generation, ind_id, total``, the last population (individuals 0 to size-1), and snapshots searched each generation.

    Of the population, individuals chosen by chance mate in pairs, which gives two children each (``crossover_repaired``), and others
    chosen by chance leave a mutant: at the snapshot of the least score a node gets its most important peer, or any, with
    equal chances. Of all together the best stays and roulette draws the rest. The driver draws the chances, a few
    numbers an individual; every generation is written to the shared folder.
    """
    weights, protected = written(weights), written(protected)
    scores = Scores(pairs, c)
    current = written(start.select(*LINK))
    rated, out = scores.of(current), None
    for g in range(generations):
        rng = random.Random(f"{seed} {g}")
        mates = chosen_pairs(size, crossover_rate, c.planes, rng)
        both_ways = [row for k, (a, b, at) in enumerate(mates) for row in ((size + 2 * k, a, b, at), (size + 2 * k + 1, b, a, at))]
        parents = spark.createDataFrame(both_ways, "child int, a int, b int, point int")
        children = sequences.crossover_repaired(parents, current, spark, c, setup).select(*LINK)
        mutated = [(i, 2 * size + k, rng.random() < 0.5) for k, i in enumerate(i for i in range(size) if rng.random() < mutation_rate)]
        which = spark.createDataFrame(mutated, "ind_id int, new int, best boolean")
        own = written(current.join(which, "ind_id").select(F.col("new").alias("ind_id"), *LINK[1:], "best"))
        picks = sequences.chosen_places(rated.join(which, "ind_id").select(F.col("new").alias("ind_id"), "step", "score"), c, protected, seed, g)
        mutants = _mutants(own, picks, weights, protected, spark, c, setup, steps, seed + g)
        fresh = written(children.unionByName(mutants))
        pool = current.unionByName(fresh)
        rated = rated.unionByName(scores.of(fresh))
        total = written(rated.groupBy("ind_id").agg(F.sum("score").alias("total")))
        draws = spark.createDataFrame([(g, k, rng.random() * (1 - 1e-9)) for k in range(1, size)], "generation int, slot int, r double")
        drawn = evolve.selected(evolve.selection_probabilities(total.withColumn("generation", F.lit(g)), ["generation"]), draws, ["generation"]).select("slot", "ind_id")
        slots = written(paths.best(total, "ind_id", "total").select(F.lit(0).alias("slot"), "ind_id").unionByName(drawn))
        current = written(pool.join(slots, "ind_id").select(F.col("slot").alias("ind_id"), *LINK[1:]))
        rated = written(rated.join(slots, "ind_id").select(F.col("slot").alias("ind_id"), "step", "score"))
        rows = total.select(F.lit(g).alias("generation"), "ind_id", "total")
        out = rows if out is None else out.unionByName(rows)
    return out, current, scores.searched


def _mutants(own: DataFrame, picks: DataFrame, weights: DataFrame, protected: DataFrame, spark: SparkSession, c: Constellation, setup: int, steps: int, seed: int) -> DataFrame:
    intervals = own.select(*LINK)
    states = written(sequences.picked_states(intervals, picks, steps))
    places = states.where("state IN (0, -1)").drop("state").join(own.select("ind_id", "best").distinct(), "ind_id")
    best = sequences.best_peers(places.where("best").drop("best"), weights, protected, spark, c, setup)
    any_ = sequences.random_peers(places.where("NOT best").drop("best"), protected, spark, c, setup, seed)
    built = sequences.rebuilt(intervals, best.unionByName(any_), setup)
    return sequences.kept_up(built, states.where("state = 2"))
