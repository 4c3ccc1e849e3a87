"""Queries on evolution, annealing and the grid world, with their SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.functions import annealing
from skylattice.operators import evolve, grid, grid_world, paths
from skylattice.plans import fixtures as fx
from skylattice.plans.registry import plan
from skylattice.sources.tables import parquet

C = fx.C
_CAND = """, cand AS (SELECT id AS src, k, CAST((x + dx) * 10 + y + dy AS INT) AS dst FROM node, (VALUES (0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 2, 0)) AS v(k, dx, dy)
WHERE x + dx < 10 AND y + dy BETWEEN 0 AND 9)"""


@plan(f"""{_CAND}, w AS (SELECT src, dst, k, importance AS i FROM cand JOIN imp ON imp.id = dst)
SELECT src, dst, i AS importance FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY i DESC, k) = 1""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.best_candidate(fx.importance(spark, sf_dir), spark, C)


@plan("SELECT id, importance, least(greatest(importance - 0.5, 0), 1)::DOUBLE AS heat FROM imp")
def importance_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.importance(spark, sf_dir).withColumn("shifted", F.col("importance") - 0.5)
    return evolve.importance_heat(rows, "shifted").drop("shifted")


@plan(""", mem AS (SELECT step, gid, sat_id FROM gv WHERE gid IN (0, 4)),
i AS (SELECT a.step, a.sat_id AS s, a.sat_id + 10 AS d FROM mem AS a JOIN mem AS b ON b.step = a.step AND b.gid = a.gid AND b.sat_id = a.sat_id + 10)
SELECT st.step, node.id FROM node, (SELECT DISTINCT step FROM mem) AS st WHERE x < 9 AND NOT EXISTS (SELECT 1 FROM i WHERE i.step = st.step AND (i.s = node.id OR i.d = node.id))""")
def mutable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.mutable_nodes(fx.groups(spark, sf_dir).where("gid IN (0, 4)"), spark, C)


@plan(
    """WITH s AS (SELECT CAST(user_id % 16 AS INT) AS run_id, CAST(dayofyear(ts) AS INT) AS generation, value AS total FROM events),
b AS (SELECT run_id, generation, min(total) AS best FROM s GROUP BY run_id, generation) SELECT run_id, generation, best, min(best) OVER (PARTITION BY run_id ORDER BY generation) AS best_so_far FROM b""",
    prefix="",
)
def fitness_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as individuals: sixteen runs of users, in which a day is a generation."""
    scores = parquet(spark, sf_dir, "events").selectExpr("CAST(user_id % 16 AS INT) AS run_id", "CAST(dayofyear(ts) AS INT) AS generation", "value AS total")
    return evolve.history(scores, ["run_id"])


@plan(
    """SELECT CAST(i AS INT) AS iteration, 100 - 0.5 * i::DOUBLE AS linear, round(100 * pow(0.95, i), 9) AS exponential, round(100 / (ln(1 + i) + 1e-8), 4) AS logarithmic FROM range(1, 150) AS r(i)""",
    prefix="",
)
def cooling_schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, start = F.col("iteration"), F.lit(100.0)
    return spark.range(1, 150).select(F.col("id").cast("int").alias("iteration")).select(
        "iteration",
        annealing.linear_cooling(start, F.lit(0.5), i).alias("linear"),
        F.round(annealing.exponential_cooling(start, F.lit(0.95), i), 9).alias("exponential"),
        F.round(annealing.logarithmic_cooling(start, i), 4).alias("logarithmic"),
    )


@plan(
    """WITH c AS (SELECT event_id, value AS cur, value * (1 + user_id % 5) / 3 AS new, CAST(1 + event_id % 50 AS INT) AS temperature FROM events)
SELECT event_id, cur, new, temperature, CASE WHEN new < cur THEN 1.0::DOUBLE ELSE round(exp(-(new - cur) / (temperature + 1e-8)), 9) END AS probability FROM c""",
    prefix="",
)
def acceptance_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's value is the present cost; another one is tried at a temperature."""
    tried = parquet(spark, sf_dir, "events").selectExpr("event_id", "value AS cur", "value * (1 + user_id % 5) / 3 AS new", "CAST(1 + event_id % 50 AS INT) AS temperature")
    return tried.withColumn("probability", F.round(annealing.acceptance(F.col("cur"), F.col("new"), F.col("temperature")), 9))


@plan("SELECT event_id, value AS x, round(sin(value) + sin(10 * value / 3), 9) AS value FROM events", prefix="")
def objective_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective at every event's value."""
    points = parquet(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"))
    return points.withColumn("value", F.round(annealing.objective(F.col("x")), 9))


@plan(
    """WITH t AS (SELECT CAST(user_id % 4 AS INT) AS run_id, CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS INT) AS iteration, value AS cost FROM events),
g AS (SELECT *, lag(cost, 100) OVER (PARTITION BY run_id ORDER BY iteration) - cost AS gain FROM t) SELECT run_id, round(avg(gain), 9) AS rate FROM g WHERE iteration % 100 = 0 AND gain IS NOT NULL GROUP BY run_id""",
    prefix="",
)
def convergence_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as iterations: four runs of users, in the order of their events."""
    rows = parquet(spark, sf_dir, "events").selectExpr("CAST(user_id % 4 AS INT) AS run_id", "event_id", "value AS cost")
    trace = rows.withColumn("iteration", (F.row_number().over(Window.partitionBy("run_id").orderBy("event_id")) - 1).cast("int"))
    return evolve.convergence_rate(trace).withColumn("rate", F.round("rate", 9))


def _runs(spark: SparkSession) -> DataFrame:
    """A 3 x 3 x 3 sweep of parameters."""
    values = "VALUES {} AS t({})"
    a, b, c = (spark.sql("SELECT * FROM " + values.format(", ".join(map(str, v)), n)) for n, v in (("start_temperature", (50.0, 100.0, 200.0)), ("alpha", (0.9, 0.95, 0.99)), ("step", (0.1, 0.5, 1.0))))
    every = a.crossJoin(b).crossJoin(c)  # the stated parameter grid
    run_id = F.floor(F.col("start_temperature") * 100 + F.col("alpha") * 1000 + F.col("step") * 10).cast("int")
    return every.select(run_id.alias("run_id"), *(F.col(x).cast("double").alias(x) for x in ("start_temperature", "alpha", "step")), F.lit(300).alias("iterations"))


_CHANCE = "((CAST(run_id AS BIGINT) * 7919 + CAST(i + 1 AS BIGINT) * 104729 + CAST({} AS BIGINT) * 1299709) * 48271) % 2147483647 / 2147483647"


@plan(
    f"""WITH RECURSIVE runs AS (SELECT CAST(user_id AS INT) AS run_id, CAST(sum(event_id) % 9000 AS BIGINT) / 1000 - 1 AS x, 50.0 * (1 + user_id % 3) AS t0, 0.9 + user_id % 2 * 0.05 AS alpha, 0.1 * (1 + user_id % 5) AS step, user_id % 2 = 0 AS scaled
  FROM events GROUP BY user_id),
chain AS (SELECT run_id, 0 AS i, CAST(x AS DOUBLE) AS x, sin(x) + sin(10 * x / 3) AS cost, sin(x) + sin(10 * x / 3) AS best, 0 AS accepted, CAST(t0 AS DOUBLE) AS t, CAST(alpha AS DOUBLE) AS alpha, CAST(step AS DOUBLE) AS step, scaled FROM runs
  UNION ALL SELECT run_id, i + 1, CASE WHEN taken THEN near ELSE x END, CASE WHEN taken THEN other ELSE cost END, least(best, CASE WHEN taken THEN other ELSE cost END), accepted + CASE WHEN taken THEN 1 ELSE 0 END, t * alpha, alpha, step, scaled
  FROM (SELECT *, {_CHANCE.format(2)} < CASE WHEN other < cost THEN 1.0 ELSE exp(-(other - cost) / (t + 1e-8)) END AS taken
        FROM (SELECT *, sin(near) + sin(10 * near / 3) AS other FROM (SELECT *, least(8.0, greatest(-1.0, x + (2 * ({_CHANCE.format(1)}) - 1) * (step * CASE WHEN scaled THEN t ELSE 1.0 END))) AS near FROM chain WHERE i < 200))))
SELECT run_id, round(x, 6) AS x, round(cost, 6) AS cost, round(best, 6) AS best, accepted FROM chain WHERE i = 200""",
    prefix="",
)
def anneal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain for each user of the events, from where their events put it; every other one with scaled steps."""
    user = F.col("user_id")
    users = parquet(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("event_id").alias("s"))
    runs = users.select(
        user.cast("int").alias("run_id"), (F.col("s") % 9000 / 1000 - 1).alias("x"), (50.0 * (1 + user % 3)).alias("start_temperature"), (0.9 + user % 2 * 0.05).alias("alpha"), (0.1 * (1 + user % 5)).alias("step"), (user % 2 == 0).alias("scaled")
    )
    found = evolve.anneal_in_columns(runs, -1.0, 8.0, 200)
    return found.select("run_id", *(F.round(c, 6).alias(c) for c in ("x", "cost", "best")), "accepted")


@plan()
def sa_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.anneal(_runs(spark), lambda x: math.sin(x) + math.sin(10 * x / 3), -1.0, 8.0)


@plan()
def sa_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _runs(spark)
    return evolve.sweep(sa_trace(spark, sf_dir), runs)


@plan()
def genetic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = paths.region_pairs(fx.groups(spark, sf_dir).where("step BETWEEN 2 AND 23"), 0, 4)
    return evolve.genetic_search(spark, fx.population(spark, sf_dir, 6), pairs, C, 6, 2)


@plan()
def greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.greedy_fill(fx.population(spark, sf_dir, 4).where("src % 3 = 0"), spark, C)


@plan()
def anneal_topologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = paths.region_pairs(fx.groups(spark, sf_dir).where("step BETWEEN 2 AND 23"), 0, 4)
    return evolve.anneal_topologies(spark, fx.population(spark, sf_dir, 4), pairs, C, 3)


_WORLD = """WITH c AS (SELECT CAST(r // 4 AS INT) AS i, CAST(r % 4 AS INT) AS j FROM range(16) AS q(r)),
m(k, action, di, dj) AS (VALUES (0, 'up', -1, 0), (1, 'down', 1, 0), (2, 'left', 0, -1), (3, 'right', 0, 1)),
t AS (SELECT i, j, action, k AS "rank", least(greatest(i + di, 0), 3) AS ni, least(greatest(j + dj, 0), 3) AS nj, -1.0::DOUBLE AS reward FROM c, m WHERE NOT (i = 0 AND j = 0) AND NOT (i = 3 AND j = 3)),
d AS (SELECT i, j, least(i + j, 6 - i - j) AS d FROM c) """


def _moves(spark: SparkSession) -> DataFrame:
    return grid_world.transitions(spark, 4, 4, ((0, 0), (3, 3)))


@plan(f'{_WORLD} SELECT i, j, action, "rank", ni, nj, reward FROM t', prefix="")
def gridworld_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark)


@plan(f"{_WORLD} SELECT i, j, round(-(1 - pow(0.9, d)) / 0.1, 4) + 0.0 AS value FROM d", prefix="")
def value_iteration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_world.optimal_values(_moves(spark)).withColumn("value", F.round("value", 4) + 0.0)


@plan(
    f'{_WORLD} SELECT t.i, t.j, action FROM t JOIN d ON d.i = t.ni AND d.j = t.nj QUALIFY row_number() OVER (PARTITION BY t.i, t.j ORDER BY d.d, "rank") = 1',
    prefix="",
)
def gridworld_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = _moves(spark)
    return grid_world.greedy_policy(moves, grid_world.optimal_values(moves))


@plan()
def policy_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_world.policy_values(_moves(spark))
