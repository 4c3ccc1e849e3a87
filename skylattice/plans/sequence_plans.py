"""Queries on populations of topology sequences, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import evolve, links, paths, sequences
from skylattice.plans import fixtures as fx
from skylattice.plans import link_plans
from skylattice.plans.registry import plan

C, T, SETUP, SIZE = fx.C, fx.STEPS, 2, 24

# Each node of an individual has one life-cycle with its candidate and, where there is room, a second one after a gap.
_SEQ = f"""{{extra}}, cand AS (SELECT id AS src, CAST((x + dx) * 10 + y + dy AS INT) AS dst FROM node, (VALUES (1, -1), (1, 0), (1, 1), (2, 0)) AS v(dx, dy) WHERE x + dx < 10 AND y + dy BETWEEN 0 AND 9),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS n FROM cand),
want AS (SELECT CAST(i AS INT) AS ind_id, src, dst FROM ranked LEFT JOIN seen ON sat_id = src CROSS JOIN range({SIZE}) AS r(i) WHERE k = (7919 * src + 104729 * i + coalesce(often, 0)) % n),
pop AS (SELECT ind_id, CAST(min(src) AS INT) AS src, dst FROM want GROUP BY ind_id, dst),
once AS (SELECT ind_id, src, dst, CAST((src * 5 + 3 * ind_id) % 7 AS INT) AS t_setup, CAST((src * 5 + 3 * ind_id) % 7 + 6 + (src + ind_id) % 9 AS INT) AS t_end FROM pop),
seq AS (SELECT ind_id, src, dst, t_setup, CAST(t_setup + 2 AS INT) AS t_work, CAST(least(23, t_end) AS INT) AS t_end FROM once
UNION ALL SELECT ind_id, src, dst, CAST(t_end + 1 + src % 3 AS INT), CAST(t_end + 3 + src % 3 AS INT), 23 FROM once WHERE t_end + 3 + src % 3 <= 23)"""


def _start(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    return start(spark, size, fx.population(spark, sf_dir, size))


def start(spark: SparkSession, size: int = SIZE, pop: DataFrame | None = None) -> DataFrame:
    """A population of sequences from one of static individuals."""
    pop = evolve.population(spark, C, size) if pop is None else pop
    begin = ((F.col("src") * 5 + 3 * F.col("ind_id")) % 7).cast("int")
    once = pop.select("ind_id", "src", "dst", begin.alias("t_setup"), (begin + 6 + (F.col("src") + F.col("ind_id")) % 9).cast("int").alias("t_end"))
    first = once.select("ind_id", "src", "dst", "t_setup", (F.col("t_setup") + 2).cast("int").alias("t_work"), F.least(F.lit(23), "t_end").cast("int").alias("t_end"))
    again = (F.col("t_end") + 1 + F.col("src") % 3).cast("int")
    second = once.where(again + 2 <= 23).select("ind_id", "src", "dst", again.alias("t_setup"), (again + 2).cast("int").alias("t_work"), F.lit(23).alias("t_end"))
    return first.unionByName(second)


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.groups(spark, sf_dir).where("gid IN (0, 4)")


@plan(_SEQ.format(extra="") + " SELECT * FROM seq")
def sequence_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _start(spark, sf_dir)


_MATES = f"mates AS (SELECT CAST(i AS INT) AS child, CAST(i AS INT) AS a, CAST((i * 5 + 1) % {SIZE} AS INT) AS b, CAST((4 * i) % 9 AS INT) AS point FROM range({SIZE}) AS r(i))"


@plan(
    _SEQ.format(extra="")
    + f""", {_MATES},
fa AS (SELECT child AS ind_id, src, dst, t_setup, t_work, t_end FROM mates JOIN seq ON ind_id = a WHERE src // 10 <= point),
fb AS (SELECT child AS ind_id, src, dst, t_setup, t_work, t_end FROM mates JOIN seq ON ind_id = b WHERE src // 10 > point)
SELECT * FROM fa UNION ALL SELECT * FROM fb WHERE NOT EXISTS (SELECT 1 FROM fa WHERE fa.ind_id = fb.ind_id AND fa.dst = fb.dst AND fa.t_setup <= fb.t_end AND fb.t_setup <= fa.t_end)"""
)
def crossover_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    mates = spark.range(SIZE).selectExpr("CAST(id AS INT) AS child", "CAST(id AS INT) AS a", f"CAST((id * 5 + 1) % {SIZE} AS INT) AS b", "CAST(4 * id % 9 AS INT) AS point")
    return sequences.crossover_intervals(mates, _start(spark, sf_dir), C)


_STATE = (
    _SEQ
    + f""", pk AS (SELECT CAST(i AS INT) AS ind_id, CAST((i * 17 + 5) % 90 AS INT) AS src, CAST((i * 7 + 3) % 22 AS INT) AS t FROM range({SIZE}) AS r(i)),
st AS (SELECT pk.ind_id, pk.src, pk.t, CAST(coalesce(max(CASE WHEN t = t_setup THEN 0 WHEN t > t_setup AND t < t_work THEN 1 WHEN t BETWEEN t_work AND t_end THEN 2 END), -1) AS INT) AS state,
  CAST(coalesce(min(CASE WHEN t_setup > t THEN t_setup END), 24) - 1 AS INT) AS until FROM pk LEFT JOIN seq ON seq.ind_id = pk.ind_id AND seq.src = pk.src GROUP BY pk.ind_id, pk.src, pk.t)"""
)


def _picks(spark: SparkSession) -> DataFrame:
    return spark.range(SIZE).selectExpr("CAST(id AS INT) AS ind_id", "CAST((id * 17 + 5) % 90 AS INT) AS src", "CAST((id * 7 + 3) % 22 AS INT) AS t")


@plan(_STATE.format(extra="") + " SELECT ind_id, src, t, state, until FROM st")
def picked_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.picked_states(_start(spark, sf_dir), _picks(spark), T)


@plan(
    _STATE.format(extra="")
    + """ SELECT pk.ind_id, pk.src, pk.t, CAST(coalesce((SELECT s.t_setup FROM seq AS s WHERE s.ind_id = pk.ind_id AND s.src = pk.src AND s.t_setup > pk.t ORDER BY s.t_setup LIMIT 1 OFFSET 1), 24) - 1 AS INT) AS until FROM pk"""
)
def second_setup_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.two_setups_ahead(_start(spark, sf_dir), _picks(spark), T)


_MUTANT = (
    _STATE.format(extra=""", mem AS (SELECT step, gid, sat_id FROM gv WHERE gid IN (0, 4)),
inner_ AS (SELECT a.step, a.sat_id AS s, a.sat_id + 10 AS d FROM mem AS a JOIN mem AS b ON b.step = a.step AND b.gid = a.gid AND b.sat_id = a.sat_id + 10),
safe AS (SELECT step, s AS id FROM inner_ UNION SELECT step, d FROM inner_)""")
    + """, wrap AS (SELECT id AS src, k, CAST((x + dx) * 10 + (y + dy + 10) % 10 AS INT) AS dst FROM node, (VALUES (0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 2, 0)) AS v(k, dx, dy) WHERE x + dx < 10),
build AS (SELECT st.ind_id, st.src, wrap.dst, t, until FROM st JOIN wrap ON wrap.src = st.src WHERE state IN (0, -1) AND until - t >= 2 AND (t + 2, wrap.dst) NOT IN (SELECT (step, id) FROM safe)
  QUALIFY row_number() OVER (PARTITION BY st.ind_id ORDER BY (SELECT importance FROM imp WHERE imp.id = wrap.dst) DESC, k) = 1),
edit AS (SELECT q.*, b.t, q.src = b.src AND q.t_setup BETWEEN b.t AND b.until AS own, q.src <> b.src AND q.dst = b.dst AND q.t_setup <= b.until AND q.t_end >= b.t AS port FROM seq AS q LEFT JOIN build AS b ON b.ind_id = q.ind_id),
r1 AS (SELECT ind_id, src, dst, t_setup, t_work, CASE WHEN coalesce(port, false) THEN t - 1 ELSE t_end END AS t_end FROM edit WHERE NOT coalesce(own, false) AND NOT (coalesce(port, false) AND NOT t_work < t)
  UNION ALL SELECT ind_id, src, dst, t, t + 2, until FROM build),
r2 AS (SELECT r1.ind_id, r1.src, r1.dst, t_setup, t_work, CASE WHEN st.t BETWEEN t_work AND t_end THEN greatest(t_end, least(until, coalesce((SELECT min(o.t_setup) FROM r1 AS o WHERE o.ind_id = r1.ind_id AND o.dst = r1.dst AND o.t_setup > r1.t_end) - 1, until))) ELSE t_end END AS t_end
  FROM r1 LEFT JOIN st ON st.ind_id = r1.ind_id AND st.src = r1.src AND st.state = 2)"""
)


@plan(f"{_MUTANT} SELECT ind_id, src, dst, t_setup, CAST(t_work AS INT) AS t_work, CAST(t_end AS INT) AS t_end FROM r2")
def mutate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = sequences.region_ends(_members(spark, sf_dir), C)
    return sequences.mutate_intervals(_start(spark, sf_dir), _picks(spark), fx.importance(spark, sf_dir), safe, spark, C, SETUP, T)


@plan(f"{_MUTANT} SELECT ind_id, src, dst, t, until FROM build")
def establish_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sequences.picked_states(_start(spark, sf_dir), _picks(spark), T).where("state IN (0, -1)").drop("state")
    return sequences.best_peers(places, fx.importance(spark, sf_dir), sequences.region_ends(_members(spark, sf_dir), C), spark, C, SETUP)


@plan(f"{_MUTANT} SELECT ind_id, src, dst, t_setup, CAST(t_work AS INT) AS t_work, CAST(t_end AS INT) AS t_end FROM r1 WHERE ind_id IN (SELECT ind_id FROM st WHERE state = -1)")
def disconnect_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _start(spark, sf_dir)
    places = sequences.picked_states(whole, _picks(spark), T).where("state = -1").drop("state")
    wanted = sequences.best_peers(places, fx.importance(spark, sf_dir), sequences.region_ends(_members(spark, sf_dir), C), spark, C, SETUP)
    return sequences.rebuilt(whole.join(places.select("ind_id"), "ind_id", "left_semi"), wanted, SETUP)


_SCORE = (
    _SEQ.format(extra="")
    + """, few AS (SELECT * FROM seq WHERE ind_id < 3),
edge AS (SELECT ind_id, CAST(s AS INT) AS step, src, dst FROM few, range(24) AS r(s) WHERE s BETWEEN t_work AND t_end UNION SELECT ind_id, CAST(s AS INT), dst, src FROM few, range(24) AS r(s) WHERE s BETWEEN t_work AND t_end
  UNION SELECT CAST(i AS INT), CAST(s AS INT), src, dst FROM ring, range(3) AS q(i), range(24) AS r(s)),
pairs AS (SELECT a.step, a.sat_id AS src, b.sat_id AS dst FROM gv AS a JOIN gv AS b ON b.step = a.step AND a.gid = 0 AND b.gid = 4),
bfs AS (SELECT DISTINCT CAST(i AS INT) AS ind_id, step, src, src AS node, 0 AS h FROM pairs, range(3) AS q(i) UNION SELECT b.ind_id, b.step, b.src, e.dst, b.h + 1 FROM bfs AS b JOIN edge AS e ON e.ind_id = b.ind_id AND e.step = b.step AND e.src = b.node WHERE b.h < 60),
best AS (SELECT ind_id, step, src, node, min(h) AS h FROM bfs GROUP BY ALL)
SELECT CAST(i AS INT) AS ind_id, p.step, round(sum(coalesce(h, 30)) / count(*), 9) AS score FROM pairs AS p CROSS JOIN range(3) AS q(i) LEFT JOIN best ON best.ind_id = i AND best.step = p.step AND best.src = p.src AND best.node = p.dst GROUP BY i, p.step"""
)


@plan(_SCORE)
def sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = paths.region_pairs(fx.groups(spark, sf_dir), 0, 4)
    return sequences.sequence_scores(_start(spark, sf_dir, 3), pairs, spark, C).withColumn("score", F.round("score", 9))


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    members = _members(spark, sf_dir)
    return paths.region_pairs(members.where("step BETWEEN 2 AND 23"), 0, 4), fx.importance(spark, sf_dir), sequences.region_ends(members, C)


@plan()
def evolve_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.evolve_sequences(spark, _start(spark, sf_dir, 4), *_search(spark, sf_dir), C, SETUP, T, 2)[0]


@plan()
def anneal_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.anneal_sequences(spark, _start(spark, sf_dir, 4), *_search(spark, sf_dir), C, SETUP, T, 3)[0]


# The skeleton of group g is individual g.
_BUILT = link_plans._SKELETON + """, z AS (SELECT gid AS ind_id, src, dst, t_setup, t_work, t_end FROM skel),
wrap AS (SELECT id AS src, k, CAST((x + dx) * 10 + (y + dy + 10) % 10 AS INT) AS dst FROM node, (VALUES (0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 2, 0)) AS v(k, dx, dy) WHERE x + dx < 10),
open_ AS (SELECT i.ind_id, wrap.src, wrap.dst, k FROM (SELECT DISTINCT ind_id FROM z) AS i, wrap WHERE (i.ind_id, wrap.src) NOT IN (SELECT (ind_id, src) FROM z) AND (i.ind_id, wrap.dst) NOT IN (SELECT (ind_id, dst) FROM z)),
best AS (SELECT ind_id, src, dst FROM open_ QUALIFY row_number() OVER (PARTITION BY ind_id, src ORDER BY (SELECT importance FROM imp WHERE imp.id = dst) DESC, k) = 1)
SELECT * FROM z UNION ALL SELECT ind_id, CAST(min(src) AS INT), dst, 0, 2, 23 FROM best GROUP BY ind_id, dst"""


@plan(_BUILT)
def built_on_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    skeleton = link_plans.region_skeleton(spark, sf_dir).withColumnRenamed("gid", "ind_id")
    return sequences.built_on_regions(skeleton, fx.importance(spark, sf_dir), spark, C, SETUP, T)


_OWNED = """, ind AS (SELECT DISTINCT step AS ind_id, CASE step % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 9 END AS mul, step * 3 % 10 AS turn FROM gv WHERE gid = 0),
owned AS (SELECT a.step AS ind_id, a.sat_id AS src, CAST(a.sat_id + 10 AS INT) AS dst FROM gv AS a JOIN gv AS b ON b.step = a.step AND b.gid = 0 AND b.sat_id = a.sat_id + 10 WHERE a.gid = 0),
s AS (SELECT ind_id, x, id AS src, row_number() OVER (PARTITION BY ind_id, x ORDER BY y) AS k FROM ind, node WHERE x < 9 AND (ind_id, id) NOT IN (SELECT (ind_id, src) FROM owned)),
d AS (SELECT ind_id, x - 1 AS x, id AS dst, row_number() OVER (PARTITION BY ind_id, x ORDER BY (y * mul + turn) % 10) AS k FROM ind, node WHERE (ind_id, id) NOT IN (SELECT (ind_id, dst) FROM owned))
SELECT ind_id, src, dst FROM owned UNION ALL SELECT s.ind_id, src, dst FROM s JOIN d ON d.ind_id = s.ind_id AND d.x = s.x AND d.k = s.k"""


@plan(_OWNED)
def plane_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An individual a step, in which the links inside group 0 are owned."""
    members = fx.groups(spark, sf_dir).where("gid = 0")
    ids = members.select("step").distinct().selectExpr("step AS ind_id", "CASE step % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 ELSE 9 END AS step", "step * 3 % 10 AS turn")
    owned = links.region_internal(members, C).select(F.col("step").alias("ind_id"), "src", "dst")
    return evolve.plane_matching(ids, owned, spark, C)


@plan(
    _SEQ.format(extra="")
    + """, pk AS (SELECT CAST(i AS INT) AS ind_id, CAST(i * 13 % 90 AS INT) AS place, CAST(i % 3 - 1 AS INT) AS shift FROM range(20) AS r(i)),
pe AS (SELECT *, CAST((place // 10 + 1) * 10 + (place % 10 + shift + 10) % 10 AS INT) AS peer FROM pk)
SELECT pop.ind_id, src, dst FROM pop LEFT JOIN pe ON pe.ind_id = pop.ind_id WHERE pe.place IS NULL OR (src <> place AND NOT (src // 10 = place // 10 AND dst = peer)) UNION ALL SELECT ind_id, place, peer FROM pe"""
)
def mutated_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = evolve.to_array(fx.population(spark, sf_dir, SIZE), C.size)
    picks = spark.range(20).selectExpr("CAST(id AS INT) AS ind_id", "CAST(id * 13 % 90 AS INT) AS place", "CAST(id % 3 - 1 AS INT) AS shift")
    return evolve.from_array(evolve.mutate_arrays(arrays, picks, C))
