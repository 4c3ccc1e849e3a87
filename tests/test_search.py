"""The search with incremental scores: equal to scoring everything, valid sequences, chances as they are said."""

import random

from pyspark.sql import functions as F

from skylattice.functions.grid import Constellation
from skylattice.operators import fill, grid, links, search, sequences
from skylattice.sources.shared import written

C = Constellation(5, 4)
SETUP, STEPS, SIZE = 2, 12, 8


def start(spark):
    none = spark.createDataFrame([], "ind_id int, src int, dst int, t_setup int, t_work int, t_end int")
    inds = spark.range(SIZE).select(F.col("id").cast("int").alias("ind_id"))
    return written(links.extended(fill.filled_over_time(none, inds, C, SETUP, STEPS), STEPS, ("ind_id",)))


def pairs(spark):
    return spark.createDataFrame([(t, s, d) for t in range(2, STEPS) for s in (0, 1) for d in (14, 17, 19)], "step int, src int, dst int")


def test_scores_are_those_of_a_full_search(spark):
    population = start(spark)
    kept = search.Scores(pairs(spark), C)
    got = {(r.ind_id, r.step): r.score for r in kept.of(population).collect()}
    want = {(r.ind_id, r.step): r.score for r in sequences.sequence_scores(population, pairs(spark), spark, C).collect()}
    assert got == want and len(got) == SIZE * 10
    # seen snapshots are not searched again, one changed link is
    kept.of(population.where("ind_id < 3"))
    one = population.where("ind_id = 0")
    gone = one.where(F.col("t_work") <= 6).orderBy(F.desc("t_end")).first()
    left = one.where(f"NOT (src = {gone.src} AND t_setup = {gone.t_setup})")
    again = {r.step: r.score for r in kept.of(left).collect()}
    assert kept.searched[1] == 0 and 0 < kept.searched[2] <= gone.t_end - gone.t_work + 1
    assert again == {r.step: r.score for r in sequences.sequence_scores(left, pairs(spark), spark, C).collect()}


def test_a_search_keeps_the_best_and_valid_sequences(spark):
    weights = grid.nodes(spark, C).select("id", (F.col("id") * 7 % 11 / 10).alias("importance"))
    protected = spark.createDataFrame([(3, 5)], "step int, id int")
    out, last, searched = search.search_sequences(spark, start(spark), SIZE, pairs(spark), weights, protected, C, SETUP, STEPS, 3, crossover_rate=0.6, mutation_rate=0.6)
    rows = out.collect()
    best = [min(r.total for r in rows if r.generation == g) for g in range(3)]
    assert best == sorted(best, reverse=True)
    assert sequences.violations(last, SETUP, STEPS).isEmpty()
    assert {r.ind_id for r in last.select("ind_id").distinct().collect()} == set(range(SIZE))
    assert searched[0] <= SIZE * 10 and all(n < sum(1 for r in rows if r.generation == g) * 10 for g, n in enumerate(searched[1:]))


def test_mates_are_chosen_by_chance():
    n = [len(search.chosen_pairs(200, 0.15, 10, random.Random(k))) for k in range(400)]
    assert 14 < sum(n) / len(n) < 15.5
    some = search.chosen_pairs(50, 0.5, 10, random.Random(1))
    used = [i for a, b, _ in some for i in (a, b)]
    assert used == sorted(set(used)) and {at for *_, at in search.chosen_pairs(200, 1, 10, random.Random(2))} == set(range(9))
    assert search.chosen_pairs(1, 1, 10, random.Random(0)) == []
