"""Evolving topologies: selection, crossover and mutation on populations of link tables, and annealing chains.

An individual is the rows ``ind_id, src, dst, t_setup, t_work, t_end`` of its links; a static one an array whose entry
is the right neighbour of its position, or -1.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions.annealing import acceptance, objective
from skylattice.functions.grid import Constellation, plane, slot
from skylattice.operators import grid, paths
from skylattice.operators.fill import MODULUS, mixed
from skylattice.sources.shared import written


def wishes(spark: SparkSession, c: Constellation, size: int, seen: DataFrame | None = None) -> DataFrame:
    """``ind_id, src, dst``: each node of each individual takes one of its candidates, by a rule of id, individual and how often it is seen (``src, seen``)."""
    targets = grid.candidates(spark, c).groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("to"))
    often = F.lit(0).cast("long")
    if seen is not None:
        targets, often = targets.join(seen, "src", "left"), F.coalesce("seen", F.lit(0).cast("long"))
    every = targets.select("src", "to", often.alias("seen"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("ind_id"))
    chosen = F.pmod(F.lit(7919) * F.col("src") + F.lit(104729) * F.col("ind_id") + F.col("seen"), F.size("to")).cast("int")
    return every.select("ind_id", "src", F.get("to", chosen).alias("dst"))


def population(spark: SparkSession, c: Constellation, size: int, seen: DataFrame | None = None) -> DataFrame:
    """Static individuals ``ind_id, src, dst`` of what nodes wish, without conflicts."""
    return without_conflicts(wishes(spark, c, size, seen))


def without_conflicts(links: DataFrame) -> DataFrame:
    """Where several nodes want one target, the smallest keeps it."""
    return links.groupBy("ind_id", "dst").agg(F.min("src").alias("src")).select("ind_id", "src", "dst")


def duplicate_targets(links: DataFrame) -> DataFrame:
    """Targets that more than one node of an individual wants."""
    return links.groupBy("ind_id", "dst").agg(F.count("*").alias("n")).where("n > 1")


def to_array(links: DataFrame, size: int) -> DataFrame:
    """``ind_id, chromosome``: positions without a link hold -1."""
    by = links.groupBy("ind_id").agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias("m"))
    return by.select("ind_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("int")), F.lit(-1))).alias("chromosome"))


def from_array(arrays: DataFrame) -> DataFrame:
    return arrays.select("ind_id", F.posexplode("chromosome").alias("src", "dst")).where("dst <> -1")


def crossover(parents: DataFrame, links: DataFrame, c: Constellation) -> DataFrame:
    """Children ``ind_id, src, dst`` of ``parents`` (``child, a, b, point``): planes up to the point from ``a``, others from ``b``.

    A target that both sides reach stays with ``a``.
    """
    x = plane("src", c)
    first = parents.join(links.withColumnRenamed("ind_id", "a"), "a").where(x <= F.col("point")).select(F.col("child").alias("ind_id"), "src", "dst", F.lit(0).alias("side"))
    second = parents.join(links.withColumnRenamed("ind_id", "b"), "b").where(x > F.col("point")).select(F.col("child").alias("ind_id"), "src", "dst", F.lit(1).alias("side"))
    kept = first.unionByName(second).groupBy("ind_id", "dst").agg(F.min_by("src", F.struct("side", "src")).alias("src"))
    return kept.select("ind_id", "src", "dst")


def mutate(links: DataFrame, picks: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """Gives the picked nodes (``ind_id, src, rank``) the candidate of that rank, if nobody has it, and else no link."""
    wanted = picks.join(grid.candidates(spark, c), ["src", "rank"], "left").select("ind_id", "src", "dst")
    others = links.join(picks.select("ind_id", "src"), ["ind_id", "src"], "left_anti")
    fresh = wanted.where("dst IS NOT NULL").join(others.select("ind_id", "dst"), ["ind_id", "dst"], "left_anti")
    return others.unionByName(without_conflicts(fresh))


def mutate_arrays(arrays: DataFrame, picks: DataFrame, c: Constellation) -> DataFrame:
    """Gives the picked place of each array (``ind_id, place, shift``) the next plane's node ``shift`` slots on.

    Slots are a ring. Other nodes of the plane that have this neighbour lose theirs; arrays that are not picked stay.
    """
    column = F.floor(F.col("place") / c.slots)
    peer = ((column + 1) * c.slots + F.pmod(F.col("place") % c.slots + F.col("shift"), F.lit(c.slots))).cast("int")

    def at(now: Column, i: Column) -> Column:
        return F.when(i == F.col("place"), F.col("peer")).when((F.floor(i / c.slots) == column) & (now == F.col("peer")), -1).otherwise(now)

    marked = arrays.join(picks, "ind_id", "left").withColumn("peer", peer)
    return marked.select("ind_id", F.transform("chromosome", at).alias("chromosome"))


def plane_matching(individuals: DataFrame, owned: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """``ind_id, src, dst`` of individuals whose nodes each have a neighbour of their own in the next plane.

    Owned links (``ind_id, src, dst``) stay. In each plane the k-th free node gets the k-th free target, in an order of nodes
    and one of targets that differ by individual (``ind_id, step, turn``: multiplier prime to the slots, and offset).
    """
    every = individuals.select("*", F.explode(F.sequence(F.lit(0), F.lit(c.size - 1))).alias("id")).withColumns({"x": plane("id", c), "y": slot("id", c)})

    def free(port: str, order: Column) -> DataFrame:
        rows = every.select("ind_id", "x", F.col("id").alias(port), order.alias("o")).join(owned.select("ind_id", port), ["ind_id", port], "left_anti")
        return rows.withColumn("k", F.row_number().over(Window.partitionBy("ind_id", "x").orderBy("o")))

    turned = F.pmod(F.col("y") * F.col("step") + F.col("turn"), F.lit(c.slots))
    sources = free("src", F.col("y"))
    targets = free("dst", turned).withColumn("x", F.col("x") - 1)
    new = sources.where(F.col("x") < c.planes - 1).join(targets.select("ind_id", "x", "k", "dst"), ["ind_id", "x", "k"])
    return owned.select("ind_id", "src", "dst").unionByName(new.select("ind_id", "src", "dst"))


def topology_of(individuals: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """Edges ``topo, src, dst`` of static individuals: links and rings, both ways."""
    rings = grid.ring_edges(spark, c).join(individuals.select("ind_id").distinct())  # the fixed ring of every individual
    return grid.bidirectional(individuals.unionByName(rings.select("ind_id", "src", "dst"))).select(F.col("ind_id").cast("long").alias("topo"), "src", "dst")


def scored(individuals: DataFrame, pairs: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """``ind_id, step, score``: mean hops of the pairs ``step, src, dst`` in each individual, 30 where no path leads."""
    edges = topology_of(individuals, spark, c)
    ids = edges.select("topo").distinct()
    sources = pairs.select("src").distinct().join(ids)  # sources of all individuals
    found = paths.hops_by_topology(edges, sources)
    every = pairs.join(ids)  # the stated pairs against every individual
    hops = every.join(found, ["topo", "src", "dst"], "left").withColumn("hops", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.col("hops")))
    return paths.snapshot_fitness(hops, ["topo", "step"]).select(F.col("topo").cast("int").alias("ind_id"), "step", "score")


def filter_and_replenish(fitness: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """In each population (columns ``by``) an individual with infinite ``total`` is replaced by one of its best, drawn by a hash of its id."""
    lost = F.col("total").isNull() | F.col("total").isin(float("inf"), float("-inf")) | F.isnan("total")
    least = fitness.where(~lost).groupBy(*by).agg(F.min("total").alias("least"))
    best = fitness.join(least, by).where(F.col("total") == F.col("least")).groupBy(*by, "least").agg(F.array_sort(F.collect_list("ind_id")).alias("best"))
    both = fitness.join(best, by)
    nth = F.pmod(F.floor(mixed(F.col("ind_id"), F.lit(0), F.lit(0), seed) / 1000), F.size("best")).cast("int")
    return both.select(*by, F.col("ind_id").alias("slot"), F.when(lost, F.get("best", nth)).otherwise(F.col("ind_id")).alias("ind_id"), F.when(lost, F.col("least")).otherwise(F.col("total")).alias("total"))


def selection_probabilities(fitness: DataFrame, by: list[str], floor: float = 1e-6) -> DataFrame:
    """Roulette shares of each population (columns ``by``) and their running sum in order of id; smaller scores weigh more."""
    every = Window.partitionBy(*by)
    weighed = fitness.withColumn("weight", F.max("total").over(every) - F.col("total") + floor)
    shares = weighed.withColumn("share", F.col("weight") / F.sum("weight").over(every))
    return shares.select(*by, "ind_id", "share", F.sum("share").over(every.orderBy("ind_id")).alias("upto"))


def selected(probabilities: DataFrame, draws: DataFrame, by: list[str]) -> DataFrame:
    """``slot, ind_id``: for each draw ``slot, r`` of a population the first individual whose running sum reaches it."""
    return draws.join(probabilities, by).where(F.col("r") <= F.col("upto")).groupBy(*by, "slot").agg(F.min_by("ind_id", "upto").alias("ind_id"))


def ranked(fitness: DataFrame, by: list[str]) -> DataFrame:
    """The rank of each individual in its population (columns ``by``)."""
    return fitness.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("total", "ind_id")))


def history(scores: DataFrame, by: list[str]) -> DataFrame:
    """Best score of each generation and of all up to it, for each run (columns ``by``)."""
    best = scores.groupBy(*by, "generation").agg(F.min("total").alias("best"))
    return best.withColumn("best_so_far", F.min("best").over(Window.partitionBy(*by).orderBy("generation")))


def convergence_rate(trace: DataFrame, every: int = 100) -> DataFrame:
    """Mean gain between costs ``every`` iterations apart, by run."""
    before = F.lag("cost", every).over(Window.partitionBy("run_id").orderBy("iteration"))
    return trace.withColumn("gain", before - F.col("cost")).where((F.col("iteration") % every == 0) & F.col("gain").isNotNull()).groupBy("run_id").agg(F.avg("gain").alias("rate"))


def best_candidate(weights: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """Each node's candidate of the greatest importance (``id, importance``), the first of equals."""
    rows = grid.candidates(spark, c).join(weights.select(F.col("id").alias("dst"), "importance"), "dst")
    return rows.groupBy("src").agg(F.max_by("dst", F.struct("importance", -F.col("rank"))).alias("dst"), F.max("importance").alias("importance"))


def mutable_nodes(members: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """``step, id`` of nodes that may change: not in the last plane and not part of a region-internal link."""
    from skylattice.operators.links import region_internal

    inside = region_internal(members, c)
    taken = inside.select("step", F.col("src").alias("id")).unionByName(inside.select("step", F.col("dst").alias("id"))).distinct()
    every = grid.nodes(spark, c).where(F.col("x") < c.planes - 1).select("id").join(members.select("step").distinct())  # all nodes at every step
    return every.select("step", "id").join(taken, ["step", "id"], "left_anti")


def genetic_search(spark: SparkSession, start: DataFrame, pairs: DataFrame, c: Constellation, size: int, generations: int, seed: int = 0) -> DataFrame:
    """``generation, ind_id, total``: crossover, mutation and roulette selection over some generations, from the individuals 0 to size-1 of ``start``.

    Choices are hashes of seed, generation and individual, so a repeated task chooses the same. The population is
    written to the checkpoint folder every generation, which keeps lineages short and survives lost executors.
    """
    pairs = written(pairs)
    current, out = written(start), None
    chance = lambda *parts: (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 30)) / (1 << 30)).cast("double")
    for g in range(generations):
        ids = spark.range(size).select(F.col("id").cast("int").alias("child"))
        mates = ids.select("child", F.col("child").alias("a"), F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(g), "child"), F.lit(size)).cast("int").alias("b"), F.pmod(F.xxhash64(F.lit(seed + 2), F.lit(g), "child"), F.lit(c.planes - 1)).cast("int").alias("point"))
        children = crossover(mates, current, c)
        picks = children.where(chance(F.lit(g), "ind_id", "src") < 0.02).select("ind_id", "src", F.pmod(F.xxhash64(F.lit(seed + 3), F.lit(g), "ind_id", "src"), F.lit(4)).cast("int").alias("rank"))
        both = written(current.unionByName(mutate(children, picks, spark, c).withColumn("ind_id", F.col("ind_id") + size)))
        total = written(scored(both, pairs, spark, c).groupBy("ind_id").agg(F.sum("score").alias("total")))
        draws = ids.select(F.lit(g).alias("generation"), F.col("child").alias("slot"), chance(F.lit(g + 1000), "child").alias("r"))
        drawn = selected(selection_probabilities(total.withColumn("generation", F.lit(g)), ["generation"]), draws, ["generation"]).select("slot", "ind_id")
        elite = paths.best(total, "ind_id", "total").select(F.lit(0).alias("slot"), "ind_id")
        chosen = elite.unionByName(drawn.where("slot > 0"))
        current = written(both.join(chosen, "ind_id").select(F.col("slot").alias("ind_id"), "src", "dst"))
        rows = total.select(F.lit(g).alias("generation"), "ind_id", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


def greedy_fill(links: DataFrame, spark: SparkSession, c: Constellation, seed: int = 0) -> DataFrame:
    """Gives free right ports candidates with free left ports, in the order of a hash of seed and link, to ``ind_id, src, dst``.

    Each round takes the links that come first at both their ends; that is the same as going through all links in
    order, and needs few rounds. Every round is written to the shared folder.
    """
    order = F.struct(F.xxhash64(F.lit(seed), "ind_id", "src", "dst"), "src", "dst")
    current = written(links.select("ind_id", "src", "dst"))
    offers = grid.candidates(spark, c).select("src", "dst").join(current.select("ind_id").distinct())  # the candidates of every individual
    while True:
        free = offers.join(current.select("ind_id", "src"), ["ind_id", "src"], "left_anti").join(current.select("ind_id", "dst"), ["ind_id", "dst"], "left_anti")
        ordered = free.withColumn("o", order)
        by_src = ordered.groupBy("ind_id", "src").agg(F.min("o").alias("o"))
        by_dst = ordered.groupBy("ind_id", "dst").agg(F.min("o").alias("o"))
        new = written(by_src.join(by_dst, ["ind_id", "o"]).select("ind_id", "src", "dst"))
        if new.isEmpty():
            return current
        current = written(current.unionByName(new))


def anneal_topologies(spark: SparkSession, first: DataFrame, pairs: DataFrame, c: Constellation, iterations: int, start: float = 10.0, alpha: float = 0.9, seed: int = 0) -> DataFrame:
    """``iteration, ind_id, total, accepted``: chains of topologies that each change one node at a time, from the individuals of ``first``.

    All chains are scored together in every iteration; choices are hashes, so repeated tasks choose alike.
    """
    pairs = written(pairs)
    current = written(first)
    total = written(scored(current, pairs, spark, c).groupBy("ind_id").agg(F.sum("score").alias("total")))
    out = None
    for k in range(iterations):
        mark = lambda *x, k=k: F.xxhash64(F.lit(seed), F.lit(k), "ind_id", *map(F.lit, x))
        picks = total.select("ind_id", F.pmod(mark(1), F.lit(c.size - c.slots)).cast("int").alias("src"), F.pmod(mark(2), F.lit(4)).cast("int").alias("rank"))
        near = written(mutate(current, picks, spark, c))
        costs = scored(near, pairs, spark, c).groupBy("ind_id").agg(F.sum("score").alias("new"))
        chance = F.pmod(mark(3), F.lit(1 << 30)) / (1 << 30)
        temperature = start * alpha**k
        step = total.join(costs, "ind_id").withColumn("accepted", chance < acceptance(F.col("total"), F.col("new"), F.lit(temperature)))
        step = written(step.select("ind_id", F.when(F.col("accepted"), F.col("new")).otherwise(F.col("total")).alias("total"), "accepted"))
        taken = step.where("accepted").select("ind_id")
        current = written(near.join(taken, "ind_id", "left_semi").unionByName(current.join(taken, "ind_id", "left_anti")))
        total = step.select("ind_id", "total")
        rows = step.select(F.lit(k).alias("iteration"), "ind_id", "total", "accepted")
        out = rows if out is None else out.unionByName(rows)
    return out


def anneal(runs: DataFrame, cost: Callable[[float], float], low: float, high: float) -> DataFrame:
    """``run_id, iteration, x, cost, temperature, accepted`` of chains ``run_id, start_temperature, alpha, step, iterations``.

    Chains are sequential but independent, so each is one group; its random numbers come from the run's id.
    """

    def chain(key: tuple, run: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(int(key[0]))
        t, alpha, step, n = (run[k].iloc[0] for k in ("start_temperature", "alpha", "step", "iterations"))
        x = rng.uniform(low, high)
        value, rows = cost(x), []
        for i in range(int(n)):
            near = min(high, max(low, x + rng.uniform(-step, step)))
            other = cost(near)
            accepted = other < value or rng.random() < math.exp(-(other - value) / (1e-8 + t))
            if accepted:
                x, value = near, other
            rows.append((int(key[0]), i, x, value, float(t), accepted))
            t *= alpha
        return pd.DataFrame(rows, columns=["run_id", "iteration", "x", "cost", "temperature", "accepted"])

    return runs.groupBy("run_id").applyInPandas(chain, "run_id int, iteration int, x double, cost double, temperature double, accepted boolean")


def anneal_in_columns(runs: DataFrame, low: float, high: float, iterations: int, seed: int = 0) -> DataFrame:
    """``run_id, x, cost, best, accepted`` of chains ``run_id, x, start_temperature, alpha, step, scaled`` after ``iterations`` on the tutorial objective.

    All chains go on together, each a row whose state is folded over the iterations, and their chances are hashes of run
    and iteration. Where a chain is ``scaled`` its steps shrink with its temperature. Chains stay in [low, high].
    """

    def chance(i: Column, k: int) -> Column:
        return mixed(F.col("run_id"), i, F.lit(k), seed) / MODULUS

    def move(s: Column, i: Column) -> Column:
        reach = F.col("step") * F.when(F.col("scaled"), s["t"]).otherwise(1.0)
        near = F.least(F.lit(high), F.greatest(F.lit(low), s["x"] + (2 * chance(i, 1) - 1) * reach))
        tried = F.struct(near.alias("x"), objective(near).alias("cost"))

        def decide(n: Column) -> Column:
            taken = chance(i, 2) < acceptance(s["cost"], n["cost"], s["t"])
            cost = F.when(taken, n["cost"]).otherwise(s["cost"])
            kept = F.when(taken, n["x"]).otherwise(s["x"])
            return F.struct(kept.alias("x"), cost.alias("cost"), F.least(s["best"], cost).alias("best"), (s["accepted"] + taken.cast("int")).alias("accepted"), (s["t"] * F.col("alpha")).alias("t"))

        return F.get(F.transform(F.array(tried), decide), F.lit(0))  # names the tried place once

    start = F.struct(F.col("x").alias("x"), objective(F.col("x")).alias("cost"), objective(F.col("x")).alias("best"), F.lit(0).alias("accepted"), F.col("start_temperature").alias("t"))
    return runs.select("run_id", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, move).alias("s")).select("run_id", "s.x", "s.cost", "s.best", "s.accepted")


def sweep(trace: DataFrame, runs: DataFrame) -> DataFrame:
    """Final and best cost of every parameter combination."""
    found = trace.groupBy("run_id").agg(F.max_by("cost", "iteration").alias("final_cost"), F.min("cost").alias("best_cost"))
    return runs.join(found, "run_id")


def importance_heat(scores: DataFrame, column: str = "score") -> DataFrame:
    """A column clipped to [0, 1]."""
    heat: Column = F.least(F.greatest(F.col(column), F.lit(0.0)), F.lit(1.0))
    return scores.withColumn("heat", heat)
