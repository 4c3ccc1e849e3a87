"""Populations of topology sequences: crossover, mutation, search and annealing on links that come and go.

An individual is the rows ``ind_id, src, dst, t_setup, t_work, t_end`` of its links: set up from ``t_setup``, working from
``t_work`` to ``t_end``. A node has one right link and one left link at a time, so the rows of a source, and those of
a target, do not overlap; all edits here keep that. Edits are joins on the individual and a port, so populations of any
size spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.annealing import acceptance
from skylattice.functions.grid import Constellation, node_id, plane
from skylattice.operators import grid, links, paths
from skylattice.operators.evolve import selected, selection_probabilities
from skylattice.operators.fill import mixed
from skylattice.sources.shared import written

LINK = ["ind_id", "src", "dst", "t_setup", "t_work", "t_end"]


def crossover_intervals(parents: DataFrame, intervals: DataFrame, c: Constellation) -> DataFrame:
    """Children of ``parents`` (``child, a, b, point``): links from planes up to the point come from ``a``, others from ``b``.

    A link of ``b`` goes whole if one of ``a`` needs its target's port at any step of its life.
    """
    x = plane("src", c)

    def side(parent: str) -> DataFrame:
        return parents.join(intervals.withColumnRenamed("ind_id", parent), parent).select(F.col("child").alias("ind_id"), "point", *LINK[1:])

    first = side("a").where(x <= F.col("point")).select(*LINK)
    taken = first.select("ind_id", "dst", F.col("t_setup").alias("from"), F.col("t_end").alias("to"))
    second = side("b").where(x > F.col("point")).join(taken, ["ind_id", "dst"], "left")
    meets = F.coalesce(F.col("from") <= F.col("t_end"), F.lit(False)) & F.coalesce(F.col("t_setup") <= F.col("to"), F.lit(False))
    kept = second.groupBy(*LINK).agg(F.bool_or(meets).alias("lost")).where("NOT lost").select(*LINK)
    return first.unionByName(kept)


def crossover_repaired(parents: DataFrame, intervals: DataFrame, spark: SparkSession, c: Constellation, setup: int) -> DataFrame:
    """``LINK`` and ``repair`` of children of ``parents`` (``child, a, b, point``), whose cut port conflicts are mended and not only dropped.

    Links from planes up to the point come from ``a``; those of them that end beyond it take over their targets' left ports
    (``rewritten``). Links of ``b`` that need such a port at the same time lose it from the first such step on: one that had worked
    before then ends there (``cut``), others go. What is lost finds another home if it can (``re-homed``): the source sets up a
    link to the first candidate whose left port nobody uses up to the old link's end, if there is room for a set-up and a
    step. Of new links that want one port at a time that of the smallest source stays.
    """
    x = plane("src", c)

    def side(parent: str) -> DataFrame:
        return parents.join(intervals.withColumnRenamed("ind_id", parent), parent).select(F.col("child").alias("ind_id"), "point", *LINK[1:])

    def meets(a: str, b: str) -> F.Column:
        return (F.col(f"{a}.t_setup") <= F.col(f"{b}.t_end")) & (F.col(f"{b}.t_setup") <= F.col(f"{a}.t_end"))

    rewritten = F.when(plane("dst", c) > F.col("point"), "rewritten").otherwise("none")
    first = side("a").where(x <= F.col("point")).select(*LINK, rewritten.alias("repair"))
    second = side("b").where(x > F.col("point")).select(*LINK)
    clash = second.alias("b").join(first.select(*LINK).alias("a"), (F.col("a.ind_id") == F.col("b.ind_id")) & (F.col("a.dst") == F.col("b.dst")) & meets("a", "b"), "left")
    since = F.min(F.when(F.col("a.t_setup").isNotNull(), F.greatest("a.t_setup", "b.t_setup")))  # greatest() passes over nulls
    found = written(clash.groupBy(*(F.col(f"b.{k}").alias(k) for k in LINK)).agg(since.alias("since")))
    whole = found.where("since IS NULL").select(*LINK, F.lit("none").alias("repair"))
    cut = found.where("since > t_work").select(*LINK[:-1], (F.col("since") - 1).cast("int").alias("t_end"), F.lit("cut").alias("repair"))
    kept = first.unionByName(whole).unionByName(cut)

    homeless = found.where(F.col("t_end") - F.col("since") >= setup).select("ind_id", "src", F.col("dst").alias("old"), F.col("since").alias("t_setup"), "t_end")
    homes = homeless.join(wrapped_candidates(spark, c), "src").where("dst <> old")
    used = homes.alias("h").join(kept.alias("k"), (F.col("h.ind_id") == F.col("k.ind_id")) & (F.col("h.dst") == F.col("k.dst")) & meets("h", "k"), "left_anti")
    wanted = used.groupBy("ind_id", "src", "t_setup", "t_end").agg(F.min_by("dst", "rank").alias("dst"))
    ahead = (F.col("w.ind_id") == F.col("o.ind_id")) & (F.col("w.dst") == F.col("o.dst")) & (F.col("o.src") < F.col("w.src")) & meets("w", "o")
    new = wanted.alias("w").join(wanted.alias("o"), ahead, "left_anti")
    return kept.unionByName(new.select("ind_id", "src", "dst", "t_setup", (F.col("t_setup") + setup).cast("int").alias("t_work"), "t_end", F.lit("re-homed").alias("repair")))


def picked_states(intervals: DataFrame, picks: DataFrame, steps: int) -> DataFrame:
    """``ind_id, src, t, state, until`` of picked places: the state there, and the last step before the node's next set-up."""
    own = picks.join(intervals, ["ind_id", "src"], "left")
    now = F.col("t").between(F.col("t_setup"), F.col("t_end"))
    state = F.when(now, F.when(F.col("t") == F.col("t_setup"), 0).when(F.col("t") < F.col("t_work"), 1).otherwise(2))
    later = F.min(F.when(F.col("t_setup") > F.col("t"), F.col("t_setup")))
    found = own.groupBy("ind_id", "src", "t").agg(F.max(state).alias("state"), later.alias("next"))
    return found.select("ind_id", "src", "t", F.coalesce("state", F.lit(-1)).alias("state"), (F.coalesce("next", F.lit(steps)) - 1).cast("int").alias("until"))


def two_setups_ahead(intervals: DataFrame, picks: DataFrame, steps: int) -> DataFrame:
    """``ind_id, src, t, until``: the last step before the second set-up of a picked node after ``t``, or the last of all."""
    own = picks.join(intervals, ["ind_id", "src"], "left")
    ahead = F.array_sort(F.collect_set(F.when(F.col("t_setup") > F.col("t"), F.col("t_setup"))))
    return own.groupBy("ind_id", "src", "t").agg(ahead.alias("a")).select("ind_id", "src", "t", (F.coalesce(F.get("a", F.lit(1)), F.lit(steps)) - 1).cast("int").alias("until"))


def wrapped_candidates(spark: SparkSession, c: Constellation) -> DataFrame:
    """``src, rank, dst``: the next plane's nodes at most one slot away, slots being a ring, and the node two planes on."""
    x, y = F.col("x"), F.col("y")
    to = [F.when(x + dx < c.planes, node_id(x + dx, F.pmod(y + dy, F.lit(c.slots)), c)) for dx, dy in ((1, -1), (1, 0), (1, 1), (2, 0))]
    return grid.nodes(spark, c).select(F.col("id").alias("src"), F.posexplode(F.array(*to)).alias("rank", "dst")).where("dst IS NOT NULL")


def rebuilt(intervals: DataFrame, wanted: DataFrame, setup: int) -> DataFrame:
    """Puts the links ``ind_id, src, dst, t, until`` in: at most one an individual.

    What the source sets up in that span goes. Of other links to the target those that work before ``t`` end there, the
    others that need the port in the span go.
    """
    at = wanted.select("ind_id", F.col("src").alias("w_src"), F.col("dst").alias("w_dst"), "t", "until")
    every = intervals.join(at, "ind_id", "left")
    own = (F.col("src") == F.col("w_src")) & F.col("t_setup").between(F.col("t"), F.col("until"))
    port = (F.col("src") != F.col("w_src")) & (F.col("dst") == F.col("w_dst")) & (F.col("t_setup") <= F.col("until")) & (F.col("t_end") >= F.col("t"))
    ended = F.coalesce(port & (F.col("t_work") < F.col("t")), F.lit(False))
    lost = F.coalesce(own | (port & ~ended), F.lit(False))
    kept = every.where(~lost).withColumn("t_end", F.when(ended, F.col("t") - 1).otherwise(F.col("t_end")).cast("int")).select(*LINK)
    new = wanted.select("ind_id", "src", "dst", F.col("t").alias("t_setup"), (F.col("t") + setup).cast("int").alias("t_work"), F.col("until").alias("t_end"))
    return kept.unionByName(new)


def best_peers(places: DataFrame, weights: DataFrame, protected: DataFrame, spark: SparkSession, c: Constellation, setup: int) -> DataFrame:
    """Places ``ind_id, src, t, until`` with the candidate ``dst`` of the greatest importance (``id, importance``), first of equals.

    Nodes that end a region-internal link (``step, id``) when the new one would work are no candidates; places without
    one, or with less room than a set-up and a step, have no row.
    """
    rows = places.where(F.col("until") - F.col("t") >= setup).join(wrapped_candidates(spark, c), "src").withColumn("step", (F.col("t") + setup).cast("int"))
    rows = rows.join(protected.select("step", F.col("id").alias("dst")).distinct(), ["step", "dst"], "left_anti").join(weights.select(F.col("id").alias("dst"), "importance"), "dst")
    return rows.groupBy("ind_id", "src", "t", "until").agg(F.max_by("dst", F.struct("importance", -F.col("rank"))).alias("dst"))


def random_peers(places: DataFrame, protected: DataFrame, spark: SparkSession, c: Constellation, setup: int, seed: int = 0) -> DataFrame:
    """As ``best_peers``, but the candidate is drawn by a hash of the place: each is as likely as the others."""
    rows = places.where(F.col("until") - F.col("t") >= setup).join(wrapped_candidates(spark, c), "src").withColumn("step", (F.col("t") + setup).cast("int"))
    rows = rows.join(protected.select("step", F.col("id").alias("dst")).distinct(), ["step", "dst"], "left_anti")
    listed = rows.groupBy("ind_id", "src", "t", "until").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("open"))
    drawn = F.pmod(F.floor(mixed(F.col("ind_id"), F.col("src"), F.col("t"), seed) / 1000), F.size("open")).cast("int")
    return listed.select("ind_id", "src", "t", "until", F.get("open", drawn)["dst"].alias("dst"))


def kept_up(intervals: DataFrame, places: DataFrame) -> DataFrame:
    """The link that works at each place ``ind_id, src, t, until`` goes on to ``until``, or to its target's next use."""
    at = places.select("ind_id", "src", "t", "until")
    later = intervals.alias("i").join(intervals.select("ind_id", "dst", F.col("t_setup").alias("use")).alias("u"), ["ind_id", "dst"]).where("use > t_end")
    later = later.groupBy(*LINK).agg(F.min("use").alias("use"))
    every = intervals.join(later, LINK, "left").join(at, ["ind_id", "src"], "left")
    here = F.coalesce(F.col("t").between(F.col("t_work"), F.col("t_end")), F.lit(False))
    end = F.greatest("t_end", F.least("until", F.coalesce(F.col("use") - 1, F.col("until"))))
    return every.withColumn("t_end", F.when(here, end).otherwise(F.col("t_end")).cast("int")).select(*LINK)


def mutate_intervals(intervals: DataFrame, picks: DataFrame, weights: DataFrame, protected: DataFrame, spark: SparkSession, c: Constellation, setup: int, steps: int) -> DataFrame:
    """Changes each individual at its picked place ``ind_id, src, t`` (one an individual) as the state there asks.

    Where a set-up begins the link goes to the most important candidate instead; a free node gets such a link up to
    its next set-up, if there is room; a working link is kept up over the gap behind it; during a set-up nothing happens.
    """
    states = picked_states(intervals, picks, steps)
    builds = best_peers(states.where("state IN (0, -1)").drop("state"), weights, protected, spark, c, setup)
    return kept_up(rebuilt(intervals, builds, setup), states.where("state = 2"))


def built_on_regions(skeleton: DataFrame, weights: DataFrame, spark: SparkSession, c: Constellation, setup: int, steps: int) -> DataFrame:
    """Individuals from region life-cycles (``LINK`` rows): nodes without one link for the whole time to their most important peer.

    Peers that a region link ends at are left out; of several nodes that want one peer the smallest gets it.
    """
    ids = skeleton.select("ind_id").distinct()
    open_ = ids.join(F.broadcast(wrapped_candidates(spark, c))).join(skeleton.select("ind_id", "src").distinct(), ["ind_id", "src"], "left_anti").join(skeleton.select("ind_id", "dst").distinct(), ["ind_id", "dst"], "left_anti")
    best = open_.join(weights.select(F.col("id").alias("dst"), "importance"), "dst").groupBy("ind_id", "src").agg(F.max_by("dst", F.struct("importance", -F.col("rank"))).alias("dst"))
    one = best.groupBy("ind_id", "dst").agg(F.min("src").alias("src"))
    whole = one.select("ind_id", "src", "dst", F.lit(0).alias("t_setup"), F.lit(setup).alias("t_work"), F.lit(steps - 1).alias("t_end"))
    return skeleton.select(*LINK).unionByName(whole)


def violations(intervals: DataFrame, setup: int, steps: int) -> DataFrame:
    """``ind_id, problem``: broken lives, and rows of one port that overlap."""
    life = intervals.where(f"t_setup < 0 OR t_work <> t_setup + {setup} OR t_end < t_work OR t_end >= {steps}").select("ind_id", F.lit("life").alias("problem"))
    found = [life]
    for port in ("src", "dst"):
        pairs = intervals.select("ind_id", port, F.explode(F.sequence("t_setup", "t_end")).alias("t")).groupBy("ind_id", port, "t").count().where("count > 1")
        found.append(pairs.select("ind_id", F.lit(f"two links at one {port}").alias("problem")))
    return reduce(DataFrame.unionByName, found)


def sequence_scores(intervals: DataFrame, pairs: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """``ind_id, step, score``: mean hops of the pairs ``step, src, dst`` over each individual's working links and rings at that step."""
    steps = pairs.select("step").distinct()
    alive = intervals.select("ind_id", "src", "dst", F.explode(F.sequence("t_work", "t_end")).alias("step")).join(steps, "step", "left_semi")
    places = intervals.select("ind_id").distinct().join(F.broadcast(steps))  # every individual at every asked step; steps are few
    rings = places.join(F.broadcast(grid.ring_edges(spark, c)))  # the ring is the constellation's, of a fixed size
    edges = grid.bidirectional(alive.select("ind_id", "step", "src", "dst").unionByName(rings.select("ind_id", "step", "src", "dst")))
    named = edges.withColumn("at", F.struct("ind_id", "step"))
    names, graphs = paths.distinct_topologies(named.select(F.col("at").alias("step"), "src", "dst"))
    names = names.select("step.ind_id", "step.step", "topo")
    wanted = pairs.join(names, "step")
    hops = wanted.join(paths.hops_by_topology(graphs, wanted.select("topo", "src")), ["topo", "src", "dst"], "left")
    hops = hops.withColumn("hops", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.col("hops")))
    return paths.snapshot_fitness(hops, ["ind_id", "step"])


def chosen_places(scores: DataFrame, c: Constellation, protected: DataFrame, *marks: object) -> DataFrame:
    """``ind_id, src, t``: at each individual's snapshot of the least score a node, by hash, that may change."""
    at = scores.groupBy("ind_id").agg(F.min_by("step", F.struct("score", "step")).alias("t"))
    free = at.select("*", F.explode(F.sequence(F.lit(0), F.lit((c.planes - 1) * c.slots - 1))).alias("src"))
    free = free.join(protected.select(F.col("step").alias("t"), F.col("id").alias("src")).distinct(), ["t", "src"], "left_anti")
    return free.groupBy("ind_id", "t").agg(F.min_by("src", F.xxhash64(*map(F.lit, marks), "ind_id", "src")).alias("src")).select("ind_id", "src", "t")


def region_ends(members: DataFrame, c: Constellation) -> DataFrame:
    """``step, id`` of nodes that a region-internal link joins."""
    inside = links.region_internal(members, c)
    return inside.select("step", F.col("src").alias("id")).unionByName(inside.select("step", F.col("dst").alias("id"))).distinct()


def evolve_sequences(spark: SparkSession, start: DataFrame, pairs: DataFrame, weights: DataFrame, protected: DataFrame, c: Constellation, setup: int, steps: int, generations: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """History ``generation, ind_id, total`` of a genetic search from the individuals 0 to n-1 of ``start``, and the last population.

    Children of a crossover with a partner by hash are mutated; of both, the best stays and the rest is drawn by roulette.
    Choices are hashes, so a repeated task chooses alike; every generation is written to the shared folder.
    """
    pairs, weights, protected = written(pairs), written(weights), written(protected)
    current, out = written(start.select(*LINK)), None
    size = current.agg(F.max("ind_id")).first()[0] + 1
    ids = spark.range(size).select(F.col("id").cast("int").alias("child"))

    def draw(of: int, *marks: object) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), *map(F.lit, marks), "child"), F.lit(of)).cast("int")

    for g in range(generations):
        mates = ids.select("child", F.col("child").alias("a"), draw(size, g, 1).alias("b"), draw(c.planes - 1, g, 2).alias("point"))
        children = written(crossover_intervals(mates, current, c))
        picks = chosen_places(sequence_scores(children, pairs, spark, c), c, protected, seed, g)
        mutants = mutate_intervals(children, picks, weights, protected, spark, c, setup, steps)
        both = written(current.unionByName(mutants.withColumn("ind_id", (F.col("ind_id") + size).cast("int"))))
        total = written(sequence_scores(both, pairs, spark, c).groupBy("ind_id").agg(F.sum("score").alias("total")))
        draws = ids.select(F.lit(g).alias("generation"), F.col("child").alias("slot"), (draw(1 << 30, g, 3) / (1 << 30)).alias("r"))
        drawn = selected(selection_probabilities(total.withColumn("generation", F.lit(g)), ["generation"]), draws, ["generation"]).select("slot", "ind_id")
        elite = paths.best(total, "ind_id", "total").select(F.lit(0).alias("slot"), "ind_id")
        current = written(both.join(elite.unionByName(drawn.where("slot > 0")), "ind_id").select(F.col("slot").alias("ind_id"), *LINK[1:]))
        rows = total.select(F.lit(g).alias("generation"), "ind_id", "total")
        out = rows if out is None else out.unionByName(rows)
    return out, current


def anneal_sequences(spark: SparkSession, start: DataFrame, pairs: DataFrame, weights: DataFrame, protected: DataFrame, c: Constellation, setup: int, steps: int, iterations: int, temperature: float = 10.0, alpha: float = 0.9, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """History ``iteration, ind_id, total, accepted`` of chains that mutate one place an iteration, and where they end.

    Every individual of ``start`` is a chain; all chains are changed and scored together.
    """
    pairs, weights, protected = written(pairs), written(weights), written(protected)
    current, out = written(start.select(*LINK)), None
    scores = written(sequence_scores(current, pairs, spark, c))
    for k in range(iterations):
        total = scores.groupBy("ind_id").agg(F.sum("score").alias("total"))
        picks = chosen_places(scores, c, protected, seed, k)
        near = written(mutate_intervals(current, picks, weights, protected, spark, c, setup, steps))
        near_scores = written(sequence_scores(near, pairs, spark, c))
        new = near_scores.groupBy("ind_id").agg(F.sum("score").alias("new"))
        chance = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(3), "ind_id"), F.lit(1 << 30)) / (1 << 30)
        step = total.join(new, "ind_id").withColumn("accepted", chance < acceptance(F.col("total"), F.col("new"), F.lit(temperature * alpha**k)))
        step = written(step.select("ind_id", F.when(F.col("accepted"), F.col("new")).otherwise(F.col("total")).alias("total"), "accepted"))
        taken = step.where("accepted").select("ind_id")
        current, scores = (written(b.join(taken, "ind_id", "left_semi").unionByName(a.join(taken, "ind_id", "left_anti"))) for a, b in ((current, near), (scores, near_scores)))
        rows = step.select(F.lit(k).alias("iteration"), "ind_id", "total", "accepted")
        out = rows if out is None else out.unionByName(rows)
    return out, current
