"""Every registered query of the grid engine against its SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

from skylattice.plans import conflict_plans, evolve_plans, fill_plans, grid_plans, link_plans, path_plans, sequence_plans, source_plans, wide_plans  # noqa: F401
from skylattice.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def rows(found):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    types = dict(zip(want.columns, map(str, want.types)))
    assert {c: TYPES[k] for c, k in df.dtypes} == types
    listed = ", ".join(f'"{c}"' for c in columns)
    assert rows(map(tuple, df.select(*columns).collect())) == rows(duck.sql(f"SELECT {listed} FROM ({ORACLES[name]})").fetchall())


def test_annealing_finds_good_minima(spark):
    found = QUERIES["sa_sweep"](spark, SF).collect()
    least = min(math.sin(x / 1000) + math.sin(x / 300) for x in range(-1000, 8000))
    assert len(found) == 27 and all(r.best_cost >= least - 1e-6 for r in found) and min(r.best_cost for r in found) < least + 0.05


def test_genetic_search_keeps_the_best(spark):
    found = QUERIES["genetic_search"](spark, SF).collect()
    best = [min(r.total for r in found if r.generation == g) for g in (0, 1)]
    assert len(found) == 24 and best[1] <= best[0]


def test_topology_annealing_has_a_row_a_chain_and_iteration(spark):
    found = QUERIES["anneal_topologies"](spark, SF).collect()
    assert Counter(r.iteration for r in found) == {0: 4, 1: 4, 2: 4}


def test_policy_values_are_the_fixpoint(spark):
    value = {(r.i, r.j): r.value for r in QUERIES["policy_evaluation"](spark, SF).collect()}
    for (i, j), v in value.items():
        if (i, j) not in ((0, 0), (3, 3)):
            near = [(min(3, max(0, i + a)), min(3, max(0, j + b))) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
            assert abs(v - sum(-1 + 0.9 * value[n] for n in near) / 4) < 0.01


def test_genetic_search_scores_every_step(spark):
    first = {r.ind_id: r.total for r in QUERIES["genetic_search"](spark, SF).where("generation = 0 AND ind_id < 6").collect()}
    want = {r.ind_id: r.total for r in QUERIES["individual_fitness"](spark, SF).collect()}
    assert first.keys() == want.keys() and all(abs(first[i] - want[i]) < 1e-6 for i in want)
