"""Queries on hop distances, flows and centrality, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import evolve, fixed_charge, flow, grid, paths
from skylattice.plans import fixtures as fx
from skylattice.plans.registry import plan
from skylattice.sources.shared import written
from skylattice.sources.tables import parquet, visibility_from_events

C = fx.C
#: Fixed example: a graph of eleven nodes as (from, to, cost, capacity).
FLOW_GRAPH = (
    (0, 1, 18, 60), (0, 2, 19, 60), (0, 3, 17, 60), (1, 4, 16, 40), (1, 5, 14, 30), (2, 5, 16, 50), (2, 6, 17, 30), (3, 6, 19, 40), (4, 7, 19, 60), (5, 4, 15, 20),
    (5, 7, 16, 30), (5, 8, 15, 40), (6, 5, 15, 20), (6, 9, 13, 40), (7, 10, 18, 60), (7, 8, 17, 30), (8, 10, 19, 50), (8, 9, 14, 30), (9, 10, 17, 50),
)

_TOPO = """, topo AS (SELECT step, src, dst FROM link UNION SELECT step, dst, src FROM link UNION SELECT step, src, dst FROM off, ring UNION SELECT step, dst, src FROM off, ring),
pairs AS (SELECT a.step, a.sat_id AS src, b.sat_id AS dst FROM gv AS a JOIN gv AS b ON b.step = a.step AND a.gid = 0 AND b.gid = 4),
bfs AS (SELECT DISTINCT step, src, src AS node, 0 AS h FROM pairs UNION SELECT b.step, b.src, t.dst, b.h + 1 FROM bfs AS b JOIN topo AS t ON t.step = b.step AND t.src = b.node WHERE b.h < 30),
hop AS (SELECT p.step, p.src, p.dst, CAST(min(h) AS INT) AS hops FROM pairs AS p LEFT JOIN bfs ON bfs.step = p.step AND bfs.src = p.src AND bfs.node = p.dst GROUP BY p.step, p.src, p.dst)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.region_pairs(fx.groups(spark, sf_dir), 0, 4)


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = written(fx.groups(spark, sf_dir))
    return paths.pair_hops(written(fx.topology(spark, sf_dir, members)), paths.region_pairs(members, 0, 4))


@plan(f"{_TOPO} SELECT step, src, dst FROM pairs")
def region_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@plan(f"{_TOPO} SELECT step, src, dst, hops FROM hop")
def shortest_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hops(spark, sf_dir)


@plan(f"{_TOPO} SELECT step, sum(hops) / count(hops) AS avg_hops, count(hops) AS n_pairs FROM hop GROUP BY step")
def avg_path_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.average_path(_hops(spark, sf_dir))


# On motif links alone, without rings, many pairs have no path.
_BARE = """, e AS (SELECT step, src, dst FROM link UNION SELECT step, dst, src FROM link),
pairs AS (SELECT a.step, a.sat_id AS src, b.sat_id AS dst FROM gv AS a JOIN gv AS b ON b.step = a.step AND a.gid = 0 AND b.gid = 4),
bfs AS (SELECT DISTINCT step, src, src AS node, 0 AS h FROM pairs UNION SELECT b.step, b.src, t.dst, b.h + 1 FROM bfs AS b JOIN e AS t ON t.step = b.step AND t.src = b.node WHERE b.h < 30),
hop AS (SELECT p.step, p.src, p.dst, CAST(min(h) AS INT) AS hops FROM pairs AS p LEFT JOIN bfs ON bfs.step = p.step AND bfs.src = p.src AND bfs.node = p.dst GROUP BY p.step, p.src, p.dst)"""


def _bare_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.pair_hops(grid.bidirectional(fx.links(spark, sf_dir)), _pairs(spark, sf_dir))


@plan(f"{_BARE} SELECT step, src, dst, coalesce(hops, -1) AS hops FROM hop")
def point_to_point_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bare_hops(spark, sf_dir).withColumn("hops", F.coalesce("hops", F.lit(-1)))


@plan(f"{_BARE} SELECT step, sum(coalesce(hops, 30)) / count(*) AS score FROM hop GROUP BY step")
def snapshot_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.snapshot_fitness(_bare_hops(spark, sf_dir), ["step"])


@plan(f"{_TOPO} SELECT hops, count(*) AS n FROM hop WHERE hops IS NOT NULL GROUP BY hops")
def hop_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.hop_histogram(_hops(spark, sf_dir))


_CAND = """, cand AS (SELECT id AS src, CAST((x + dx) * 10 + y + dy AS INT) AS dst FROM node, (VALUES (1, -1), (1, 0), (1, 1), (2, 0)) AS v(dx, dy) WHERE x + dx < 10 AND y + dy BETWEEN 0 AND 9),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS n FROM cand),
want AS (SELECT CAST(i AS INT) AS ind_id, src, dst FROM ranked LEFT JOIN seen ON sat_id = src CROSS JOIN range(6) AS r(i) WHERE k = (7919 * src + 104729 * i + coalesce(often, 0)) % n),
pop AS (SELECT ind_id, CAST(min(src) AS INT) AS src, dst FROM want GROUP BY ind_id, dst)"""
_SCORES = f"""{_CAND}, pedge AS (SELECT ind_id, src, dst FROM pop UNION SELECT ind_id, dst, src FROM pop UNION SELECT CAST(i AS INT), src, dst FROM ring, range(6) AS r(i)),
pairs AS (SELECT a.step, a.sat_id AS src, b.sat_id AS dst FROM gv AS a JOIN gv AS b ON b.step = a.step AND a.gid = 0 AND b.gid = 4),
bfs AS (SELECT DISTINCT CAST(i AS INT) AS ind_id, src, src AS node, 0 AS h FROM pairs, range(6) AS r(i) UNION SELECT b.ind_id, b.src, t.dst, b.h + 1 FROM bfs AS b JOIN pedge AS t ON t.ind_id = b.ind_id AND t.src = b.node WHERE b.h < 30),
best AS (SELECT ind_id, src, node, min(h) AS h FROM bfs GROUP BY ind_id, src, node),
score AS (SELECT CAST(i AS INT) AS ind_id, p.step, sum(coalesce(h, 30)) / count(*) AS score FROM pairs AS p CROSS JOIN range(6) AS r(i) LEFT JOIN best ON best.ind_id = i AND best.src = p.src AND best.node = p.dst GROUP BY i, p.step),
fit AS (SELECT ind_id, sum(score) AS total FROM score WHERE step BETWEEN 2 AND 23 GROUP BY ind_id)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.scored(fx.population(spark, sf_dir, 6), _pairs(spark, sf_dir), spark, C)


def fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.individual_fitness(_scores(spark, sf_dir), 2, 23)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The individuals as two populations."""
    return fitness(spark, sf_dir).withColumn("run_id", F.col("ind_id") % 2)


@plan(f"{_SCORES} SELECT ind_id, round(total, 9) AS total FROM fit")
def individual_fitness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fitness(spark, sf_dir).withColumn("total", F.round("total", 9))


@plan(f"{_SCORES} SELECT ind_id, round(total, 9) AS total FROM fit ORDER BY total, ind_id LIMIT 1")
def best_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.best(fitness(spark, sf_dir), "ind_id", "total").withColumn("total", F.round("total", 9))


@plan(f"{_SCORES} SELECT ind_id % 2 AS run_id, ind_id, round(total, 9) AS total, CAST(row_number() OVER (PARTITION BY ind_id % 2 ORDER BY total, ind_id) AS INT) AS \"rank\" FROM fit")
def ranked_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.ranked(_runs(spark, sf_dir), ["run_id"]).withColumn("total", F.round("total", 9))


@plan(f"""{_SCORES}, s AS (SELECT ind_id % 2 AS run_id, ind_id, (max(total) OVER (PARTITION BY ind_id % 2) - total + 1e-6) AS w FROM fit)
SELECT run_id, ind_id, round(w / sum(w) OVER (PARTITION BY run_id), 9) AS share, round(sum(w) OVER (PARTITION BY run_id ORDER BY ind_id) / sum(w) OVER (PARTITION BY run_id), 9) AS upto FROM s""")
def selection_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = evolve.selection_probabilities(_runs(spark, sf_dir), ["run_id"])
    return shares.select("run_id", "ind_id", F.round("share", 9).alias("share"), F.round("upto", 9).alias("upto"))


@plan(f"""{_SCORES}, s AS (SELECT ind_id % 2 AS run_id, ind_id, (max(total) OVER (PARTITION BY ind_id % 2) - total + 1e-6) AS w FROM fit),
p AS (SELECT run_id, ind_id, sum(w) OVER (PARTITION BY run_id ORDER BY ind_id) / sum(w) OVER (PARTITION BY run_id) AS upto FROM s),
d AS (SELECT CAST(r AS INT) AS run_id, CAST(i AS INT) AS slot, (i * 7 + r * 3) % 50 / 50 AS r FROM range(2) AS a(r), range(50) AS b(i))
SELECT d.run_id, slot, CAST(min(ind_id) AS INT) AS ind_id FROM d JOIN p ON p.run_id = d.run_id AND d.r <= upto GROUP BY d.run_id, slot""")
def roulette_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = spark.range(100).selectExpr("CAST(id div 50 AS INT) AS run_id", "CAST(id % 50 AS INT) AS slot", "(id % 50 * 7 + id div 50 * 3) % 50 / 50 AS r")
    return evolve.selected(evolve.selection_probabilities(_runs(spark, sf_dir), ["run_id"]), draws, ["run_id"])


@plan(f"""{_SCORES}, f AS (SELECT ind_id % 2 AS run_id, ind_id, CASE WHEN ind_id % 3 = 1 THEN CAST('inf' AS DOUBLE) ELSE total END AS total FROM fit),
b AS (SELECT run_id, ind_id AS bi, total AS bt FROM f WHERE NOT isinf(total) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY total, ind_id) = 1)
SELECT f.run_id, ind_id AS slot, CASE WHEN isinf(total) THEN bi ELSE ind_id END AS ind_id, round(CASE WHEN isinf(total) THEN bt ELSE total END, 9) AS total FROM f JOIN b ON b.run_id = f.run_id""")
def filter_and_replenish(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = _runs(spark, sf_dir).withColumn("total", F.when(F.col("ind_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.col("total")))
    return evolve.filter_and_replenish(lost, ["run_id"]).withColumn("total", F.round("total", 9))


# Totals in wide steps, so that some are equal.
@plan(f"""{_SCORES}, f AS (SELECT ind_id % 2 AS run_id, ind_id, CASE WHEN ind_id % 3 = 1 THEN CAST('inf' AS DOUBLE) ELSE floor(total / 40) END AS total FROM fit),
b AS (SELECT run_id, list(ind_id ORDER BY ind_id) AS bi, any_value(total) AS bt FROM (SELECT *, min(total) OVER (PARTITION BY run_id) AS m FROM f) WHERE total = m GROUP BY run_id)
SELECT f.run_id, ind_id AS slot, CASE WHEN isinf(total) THEN bi[1 + ((CAST(ind_id AS BIGINT) * 7919 * 48271) % 2147483647 // 1000) % len(bi)] ELSE ind_id END AS ind_id, CASE WHEN isinf(total) THEN bt ELSE total END AS total FROM f JOIN b ON b.run_id = f.run_id""")
def replenish_random_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where several individuals are the best, chance decides which one fills a place."""
    coarse = _runs(spark, sf_dir).withColumn("total", F.when(F.col("ind_id") % 3 == 1, F.lit(float("inf"))).otherwise(F.floor(F.col("total") / 40).cast("double")))
    return evolve.filter_and_replenish(coarse, ["run_id"])


@plan(f"{_CAND} SELECT ind_id, src, dst FROM pop")
def chromosome_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.from_array(evolve.to_array(fx.population(spark, sf_dir, 6), C.size)).select("ind_id", "src", "dst")


@plan(f"{_CAND} SELECT ind_id, dst, count(*) AS n FROM want GROUP BY ind_id, dst HAVING count(*) > 1")
def duplicate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.duplicate_targets(evolve.wishes(spark, C, 6, fx.seen(spark, sf_dir)))


@plan(f"{_CAND} SELECT CAST(ind_id AS BIGINT) AS topo, src, dst FROM pop UNION SELECT ind_id, dst, src FROM pop UNION SELECT i, src, dst FROM ring, range(6) AS r(i)")
def decode_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.topology_of(fx.population(spark, sf_dir, 6), spark, C)


@plan(f"""{_CAND}, mates AS (SELECT CAST(i AS INT) AS child, CAST(i AS INT) AS a, CAST((i + 1) % 6 AS INT) AS b, CAST((3 * i) % 9 AS INT) AS point FROM range(6) AS r(i)),
u AS (SELECT child, src, dst, 0 AS side FROM mates JOIN pop ON ind_id = a AND src // 10 <= point UNION ALL SELECT child, src, dst, 1 FROM mates JOIN pop ON ind_id = b AND src // 10 > point)
SELECT child AS ind_id, src, dst FROM u QUALIFY row_number() OVER (PARTITION BY child, dst ORDER BY side, src) = 1""")
def crossover_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    mates = spark.range(6).selectExpr("CAST(id AS INT) AS child", "CAST(id AS INT) AS a", "CAST((id + 1) % 6 AS INT) AS b", "CAST(3 * id % 9 AS INT) AS point")
    return evolve.crossover(mates, fx.population(spark, sf_dir, 6), C)


@plan(f"""{_CAND}, slot AS (SELECT id AS src, CAST((x + dx) * 10 + y + dy AS INT) AS dst, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS r
  FROM node, (VALUES (0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 2, 0)) AS v(k, dx, dy) WHERE x + dx < 10 AND y + dy BETWEEN 0 AND 9),
picks AS (SELECT ind_id, src, (src + ind_id) % 4 AS r FROM pop WHERE (src * 7 + ind_id) % 13 = 0),
others AS (SELECT * FROM pop WHERE (ind_id, src) NOT IN (SELECT (ind_id, src) FROM picks)),
fresh AS (SELECT p.ind_id, p.src, s.dst FROM picks AS p JOIN slot AS s ON s.src = p.src AND s.r = p.r WHERE (p.ind_id, s.dst) NOT IN (SELECT (ind_id, dst) FROM others))
SELECT ind_id, src, dst FROM others UNION ALL SELECT ind_id, min(src), dst FROM fresh GROUP BY ind_id, dst""")
def mutated_individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pop = fx.population(spark, sf_dir, 6)
    picks = pop.where((F.col("src") * 7 + F.col("ind_id")) % 13 == 0).select("ind_id", "src", ((F.col("src") + F.col("ind_id")) % 4).alias("rank"))
    return evolve.mutate(pop, picks, spark, C)


# A graph a step: every possible right link, which costs more the more stations see its target, from the first satellite of group 0 to the last one of group 4.
_GRAPHS = """, cand AS (SELECT id AS u, CAST((x + dx) * 10 + y + dy AS INT) AS v FROM node, (VALUES (1, -1), (1, 0), (1, 1), (2, 0)) AS c(dx, dy) WHERE x + dx < 10 AND y + dy BETWEEN 0 AND 9),
load_ AS (SELECT step, sat_id, count(*) AS n FROM vis GROUP BY step, sat_id),
ends AS (SELECT a.step, min(a.sat_id) AS s, max(b.sat_id) AS t FROM gv AS a JOIN gv AS b ON b.step = a.step AND a.gid = 0 AND b.gid = 4 GROUP BY a.step),
e AS (SELECT ends.step AS g, u, v, CAST(1 + coalesce(n, 0) AS INT) AS cost, 20 + 10 * (u % 3) AS cap FROM cand CROSS JOIN ends LEFT JOIN load_ ON load_.step = ends.step AND sat_id = v),
p AS (SELECT step AS g, s AS node, CAST(0 AS BIGINT) AS cost, [s] AS way FROM ends
  UNION ALL SELECT p.g, e.v, p.cost + e.cost, list_append(way, e.v) FROM p JOIN e ON e.g = p.g AND e.u = p.node JOIN ends ON ends.step = p.g AND e.v <= ends.t WHERE p.node <> ends.t),
done AS (SELECT g, s, t, p.cost, way FROM p JOIN ends ON ends.step = p.g AND p.node = ends.t)"""


def _step_graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``graph, u, v, cost, cap`` and ``graph, source, sink`` of every step."""
    members = written(fx.groups(spark, sf_dir))
    first = members.where("gid = 0").groupBy("step").agg(F.min("sat_id").alias("source"))
    ends = first.join(members.where("gid = 4").groupBy("step").agg(F.max("sat_id").alias("sink")), "step")
    near = grid.candidates(spark, C).groupBy("src").agg(F.collect_list("dst").alias("to"))
    every = ends.select("step", F.explode(F.sequence(F.lit(0), F.lit(C.size - 1))).alias("src")).join(near, "src").select("step", F.col("src").alias("u"), F.explode("to").alias("v"))
    seen = visibility_from_events(parquet(spark, sf_dir, "events"), C).groupBy("step", F.col("sat_id").alias("v")).agg(F.count("*").alias("n"))
    priced = every.join(seen, ["step", "v"], "left").select(F.col("step").cast("long").alias("graph"), "u", "v", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("cost"), (F.col("u") % 3 * 10 + 20).alias("cap"))
    return priced, ends.select(F.col("step").cast("long").alias("graph"), "source", "sink")


@plan(f"""{_GRAPHS} SELECT CAST(g AS BIGINT) AS graph, s AS src, t AS dst, CAST(row_number() OVER (PARTITION BY g ORDER BY cost, way) AS INT) AS "rank", cost, array_to_string(way, '-') AS path FROM done
QUALIFY row_number() OVER (PARTITION BY g ORDER BY cost, way) <= 6""")
def k_shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs, ends = _step_graphs(spark, sf_dir)
    return paths.k_shortest_paths(graphs.drop("cap"), ends.toDF("graph", "src", "dst"), 6)


@plan()
def min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs, ends = _step_graphs(spark, sf_dir)
    return flow.min_cost_flow(graphs, ends.withColumn("demand", F.lit(50)))


# No edge takes less than 20, so the cheapest way carries that much alone.
_LEAST = f"{_GRAPHS}, least AS (SELECT ends.step AS g, min(cost) AS cost FROM ends LEFT JOIN done ON done.g = ends.step GROUP BY ends.step)"


@plan(f"{_LEAST} SELECT CAST(g AS BIGINT) AS graph, CASE WHEN cost IS NULL THEN 'Infeasible' ELSE 'Optimal' END AS status, CAST(coalesce(cost, 0) * 20 AS BIGINT) AS total_cost FROM least")
def min_cost_flow_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs, ends = _step_graphs(spark, sf_dir)
    return flow.flow_summary(flow.min_cost_flow(graphs, ends.withColumn("demand", F.lit(20))))


@plan(f"{_LEAST} SELECT CAST(g AS BIGINT) AS graph, CASE WHEN cost IS NULL THEN 'Infeasible' ELSE 'Optimal' END AS status, CAST(coalesce(cost, 0) AS BIGINT) AS total_charge FROM least")
def fixed_charge_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs, ends = _step_graphs(spark, sf_dir)
    return fixed_charge.charged_flow(graphs, ends.withColumn("demand", F.lit(20))).select("graph", "status", F.coalesce("total_charge", F.lit(0)).alias("total_charge"))


# The first way by its nodes: each step goes to the smallest neighbour that is one hop nearer to the target.
@plan(f"""{_BARE}, back AS (SELECT DISTINCT step, dst, dst AS node, 0 AS h FROM pairs UNION SELECT b.step, b.dst, e.dst, b.h + 1 FROM back AS b JOIN e ON e.step = b.step AND e.src = b.node WHERE b.h < 30),
far AS (SELECT step, dst, node, min(h) AS h FROM back GROUP BY step, dst, node),
nxt AS (SELECT a.step, a.dst, a.node, min(e.dst) AS next FROM far AS a JOIN e ON e.step = a.step AND e.src = a.node JOIN far AS b ON b.step = a.step AND b.dst = a.dst AND b.node = e.dst AND b.h = a.h - 1 GROUP BY a.step, a.dst, a.node),
walk AS (SELECT step, src, dst, src AS node, CAST(src AS VARCHAR) AS path, 0 AS n FROM hop WHERE hops IS NOT NULL
  UNION ALL SELECT w.step, w.src, w.dst, x.next, w.path || '-' || x.next, w.n + 1 FROM walk AS w JOIN nxt AS x ON x.step = w.step AND x.dst = w.dst AND x.node = w.node WHERE w.node <> w.dst)
SELECT step, src, dst, CAST(n AS INT) AS hops, path FROM walk WHERE node = dst""")
def shortest_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.shortest_path_nodes(grid.bidirectional(fx.links(spark, sf_dir)), _pairs(spark, sf_dir))


@plan()
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, graphs = paths.distinct_topologies(fx.topology(spark, sf_dir))
    ends = fx.groups(spark, sf_dir).where("gid IN (0, 4)").join(names, "step").select("topo", F.col("sat_id").alias("node"), F.when(F.col("gid") == 0, "source").otherwise("target").alias("role"))
    return paths.betweenness(graphs, ends.distinct())


def _step_flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph a step with super nodes, and what goes from group 0 to group 4 over it."""
    members = written(fx.groups(spark, sf_dir))
    edges = grid.flow_edges(fx.topology(spark, sf_dir, members), C, keep=["step"])
    sources = members.where("gid = 0").select("step", F.col("sat_id").alias("node"), F.lit(10).alias("demand"))
    sinks = members.where("gid = 4").select("step", F.col("sat_id").alias("node"))
    graphs = grid.with_super_nodes(edges, sources, sinks, keep=["step"]).select(F.col("step").cast("long").alias("graph"), F.col("src").alias("u"), F.col("dst").alias("v"), "cost", "cap")
    wanted = flow.total_demand(sources, ["step"]).select(F.col("step").cast("long").alias("graph"), F.lit(-1).alias("source"), F.lit(-2).alias("sink"), "demand")
    return graphs, wanted


@plan()
def topology_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest flow from group 0 to group 4 over each step's topology: a graph a step, without its super nodes."""
    return flow.without_super_nodes(flow.min_cost_flow(*_step_flows(spark, sf_dir)))


# What a proof has to say: all is shipped, no node is unbalanced, no edge over its capacity or priced wrongly, and no gap is left.
@plan(f"""{_TOPO} SELECT CAST(step AS BIGINT) AS graph, 'Optimal' AS status, CAST(count(*) * 10 AS BIGINT) AS demand, CAST(count(*) * 10 AS BIGINT) AS shipped,
CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS over_, CAST(0 AS BIGINT) AS price, CAST(0 AS BIGINT) AS gap FROM gv WHERE gid = 0 GROUP BY step""")
def topology_flow_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof that each step's flow is the cheapest: flow and potentials, checked by joins."""
    graphs, wanted = _step_flows(spark, sf_dir)
    flows, potentials, status = flow.flow_and_potentials(graphs, wanted)
    proof = flow.certificate(flows, potentials, wanted).join(status, "graph")
    return proof.select("graph", "status", F.col("demand").cast("long").alias("demand"), "shipped", "unbalanced", F.col("over").alias("over_"), "price", "gap")


# Edges take 20, 30 or 40, so a flow of 40 is two ways, which share no edge but those that take 40. Of two places the smaller moves on, so the ways meet wherever they share.
@plan(f"""{_GRAPHS}, move AS (SELECT g, u, 1 AS ways, v AS v1, CAST(NULL AS INT) AS v2, cost FROM e
  UNION ALL SELECT p1.g, p1.u, 2, p1.v, p2.v, CASE WHEN p1.v = p2.v THEN p1.cost ELSE p1.cost + p2.cost END FROM e AS p1 JOIN e AS p2 ON p2.g = p1.g AND p2.u = p1.u AND (p1.v < p2.v OR p1.v = p2.v AND p1.cap = 40)),
two AS (SELECT step AS g, s AS a, s AS b, t, CAST(0 AS BIGINT) AS cost FROM ends
  UNION SELECT two.g, least(v1, coalesce(v2, b)), greatest(v1, coalesce(v2, b)), t, two.cost + move.cost FROM two JOIN move ON move.g = two.g AND move.u = two.a AND ways = CASE WHEN a = b THEN 2 ELSE 1 END AND v1 <= t AND coalesce(v2, b) <= t),
least_ AS (SELECT step AS g, min(cost) AS cost FROM ends LEFT JOIN two ON two.g = ends.step AND a = two.t AND b = two.t GROUP BY step)
SELECT CAST(g AS BIGINT) AS graph, CASE WHEN cost IS NULL THEN 'Infeasible' ELSE 'Optimal' END AS status, CAST(cost AS BIGINT) AS total_charge, CAST(cost AS BIGINT) AS lower_bound, CAST(cost - cost AS BIGINT) AS gap FROM least_""")
def fixed_charge_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least charges for a flow of 40 over every step's possible links, with what bounds them from below."""
    graphs, ends = _step_graphs(spark, sf_dir)
    return fixed_charge.charged_flow(graphs, ends.withColumn("demand", F.lit(40))).drop("n_edges")
