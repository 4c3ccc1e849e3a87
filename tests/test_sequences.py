import random

from skylattice.functions.grid import SMALL
from skylattice.operators import grid, links, sequences
from skylattice.plans import sequence_plans as plans
from skylattice.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(*sequences.LINK).collect()))


def test_edits_keep_every_port_single(spark):
    start = plans.start(spark)
    assert sequences.violations(start, 2, 24).isEmpty()
    for name in ("crossover_intervals", "mutate_intervals"):
        changed = QUERIES[name](spark, SF)
        assert sequences.violations(changed, 2, 24).isEmpty()
        assert rows(changed) != rows(start)
    broken = spark.createDataFrame([(0, 1, 11, 0, 2, 5), (0, 1, 12, 5, 7, 9), (0, 2, 12, 9, 11, 12), (1, 1, 11, 0, 1, 5), (1, 2, 13, 20, 22, 24)], "ind_id int, src int, dst int, t_setup int, t_work int, t_end int")
    found = sorted(map(tuple, sequences.violations(broken, 2, 24).collect()))
    assert found == [(0, "two links at one dst"), (0, "two links at one src"), (1, "life"), (1, "life")]


def brute_mutation(own, src, t, candidates, importance, protected, setup, steps):
    """One individual, place by place, from the definition."""
    own = [list(r) for r in own]
    now = [r for r in own if r[0] == src and r[2] <= t <= r[4]]
    until = min([r[2] for r in own if r[0] == src and r[2] > t], default=steps) - 1
    state = -1 if not now else 0 if t == now[0][2] else 1 if t < now[0][3] else 2
    if state == 2:
        later = [r[2] for r in own if r[1] == now[0][1] and r[2] > now[0][4]]
        now[0][4] = max(now[0][4], min([until, *(x - 1 for x in later)]))
    elif state in (0, -1) and until - t >= setup:
        free = [d for d in candidates[src] if (t + setup, d) not in protected]
        if free:
            peer = max(free, key=lambda d: importance[d])
            kept = []
            for r in own:
                if r[0] == src and t <= r[2] <= until:
                    continue
                if r[0] != src and r[1] == peer and r[2] <= until and r[4] >= t:
                    if r[3] >= t:
                        continue
                    r[4] = t - 1
                kept.append(r)
            own = [*kept, [src, peer, t, t + setup, until]]
    return sorted(map(tuple, own))


def test_mutation_equals_brute_force_at_random_places(spark):
    rng = random.Random(1)
    start = plans.start(spark, 40)
    candidates, importance = {}, {i: (i * 37 % 101) / 40 for i in range(100)}
    for r in sequences.wrapped_candidates(spark, SMALL).orderBy("src", "rank").collect():
        candidates.setdefault(r.src, []).append(r.dst)
    protected = {(rng.randrange(24), rng.randrange(100)) for _ in range(400)}
    picks = [(i, rng.randrange(90), rng.randrange(24)) for i in range(40)]
    weights = grid.nodes(spark, SMALL).selectExpr("id", "id * 37 % 101 / 40 AS importance")
    got = sequences.mutate_intervals(start, spark.createDataFrame(picks, "ind_id int, src int, t int"), weights, spark.createDataFrame(sorted(protected), "step int, id int"), spark, SMALL, 2, 24)
    before, after = rows(start), rows(got)
    for i, src, t in picks:
        assert [r[1:] for r in after if r[0] == i] == brute_mutation([r[1:] for r in before if r[0] == i], src, t, candidates, importance, protected, 2, 24)


def test_search_keeps_individuals_valid_and_the_best(spark):
    history, last = sequences.evolve_sequences(spark, plans.start(spark, 4), *plans._search(spark, SF), SMALL, 2, 24, 2)
    found = history.collect()
    assert len(found) == 2 * 8 and sorted(r.ind_id for r in found if r.generation == 0) == list(range(8))
    best = [min(r.total for r in found if r.generation == g) for g in (0, 1)]
    assert best[1] <= best[0]
    assert sequences.violations(last, 2, 24).isEmpty() and {r[0] for r in last.select("ind_id").distinct().collect()} == set(range(4))
    states = links.dense_states(links.life_cycle(last.where("ind_id = 0")), spark, SMALL, 24)
    assert links.state_violations(states).isEmpty()


def test_annealing_changes_one_place_an_iteration(spark):
    history, last = sequences.anneal_sequences(spark, plans.start(spark, 3), *plans._search(spark, SF), SMALL, 2, 24, 2)
    found = history.collect()
    assert len(found) == 6 and {(r.iteration, r.ind_id) for r in found} == {(k, i) for k in range(2) for i in range(3)}
    assert sequences.violations(last, 2, 24).isEmpty()
