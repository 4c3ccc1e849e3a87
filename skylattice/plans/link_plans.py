"""Queries on links over time and their life-cycles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import grid, links
from skylattice.plans import fixtures as fx
from skylattice.plans.registry import plan

C, T, B = fx.C, fx.STEPS, fx.SETUP

_DENSE = """, dense AS (SELECT CAST(s AS INT) AS step, id AS src, dst FROM node CROSS JOIN range(24) AS r(s) LEFT JOIN link ON link.step = s AND link.src = id),
nxt AS (SELECT *, lead(dst) OVER w AS new, lead(step) OVER w AS next, lag(dst) OVER w AS old, lag(step) OVER w AS before FROM dense WINDOW w AS (PARTITION BY src ORDER BY step))"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.filled(fx.links(spark, sf_dir), spark, C, 0, T)


@plan(f"{_DENSE} SELECT step, src, dst FROM dense")
def fill_missing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


@plan(f"""{_DENSE} SELECT step, src AS node, dst AS old, new, CASE WHEN dst IS NULL THEN 'appears' WHEN new IS NULL THEN 'ends' ELSE 'changes' END AS kind
FROM nxt WHERE next IS NOT NULL AND dst IS DISTINCT FROM new
UNION ALL SELECT d.step, d.src, d.dst, NULL, 'displaced' FROM dense AS d JOIN nxt AS n ON n.step = d.step AND n.new = d.dst
WHERE n.next IS NOT NULL AND n.dst IS DISTINCT FROM n.new AND d.src <> n.src""")
def link_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.changes(_dense(spark, sf_dir))


@plan(f"""{_DENSE}, spread AS (SELECT src, new, step AS origin, unnest(generate_series(greatest(0, step - 2), step)) AS s FROM nxt WHERE dst IS NULL AND new IS NOT NULL)
SELECT CAST(s AS INT) AS step, src, new AS dst FROM spread QUALIFY row_number() OVER (PARTITION BY s, src ORDER BY origin DESC) = 1""")
def pending_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.pending(_dense(spark, sf_dir), B, 0)


@plan(f"""{_DENSE}, gone AS (SELECT DISTINCT src, unnest(generate_series(step - 3, step - 1)) AS step FROM nxt WHERE before IS NOT NULL AND dst IS DISTINCT FROM old AND step - 3 >= 0)
SELECT step, src, dst FROM dense WHERE dst IS NOT NULL AND src // 10 <> dst // 10 AND (step, src) NOT IN (SELECT (step, src) FROM gone)""")
def links_after_teardown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.after_teardown(_dense(spark, sf_dir), C, B, 0)


@plan(f"""{_DENSE} SELECT n.step, n.src, n.new AS dst, p.dst AS previous, p.step AS previous_step FROM nxt AS n JOIN dense AS p ON p.src = n.src AND p.step BETWEEN n.step - 6 AND n.step - 1
WHERE n.dst IS NULL AND n.new IS NOT NULL AND p.dst IS NOT NULL QUALIFY row_number() OVER (PARTITION BY n.step, n.src ORDER BY p.step DESC) = 1 AND p.dst <> n.new""")
def previous_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.previous_link(_dense(spark, sf_dir), 6)


@plan(f"{_DENSE} SELECT DISTINCT src AS node FROM nxt WHERE new IS NOT NULL AND dst IS DISTINCT FROM new")
def build_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.build_points(_dense(spark, sf_dir))


@plan(f"""{_DENSE}, lab AS (SELECT id, CASE WHEN x BETWEEN 0 AND 6 AND y BETWEEN 2 AND 6 THEN 0 WHEN x BETWEEN 5 AND 9 AND y BETWEEN 1 AND 8 THEN 4 END AS r FROM node),
m AS (SELECT d.*, coalesce(a.r = b.r, false) AS inside FROM dense AS d LEFT JOIN lab AS a ON a.id = d.src LEFT JOIN lab AS b ON b.id = d.dst),
v AS (SELECT *, lead(dst) OVER w AS new, lead(inside) OVER w AS new_inside FROM m WINDOW w AS (PARTITION BY src ORDER BY step)),
gone AS (SELECT src, unnest(CASE WHEN inside AND NOT new_inside THEN generate_series(step + 1, least(23, step + 3)) ELSE generate_series(greatest(0, step - 2), step) END) AS step
         FROM v WHERE dst IS NOT NULL AND new IS NOT NULL AND dst <> new)
SELECT step, src, dst FROM dense WHERE dst IS NOT NULL AND (step, src) NOT IN (SELECT (step, src) FROM gone)""")
def resolve_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = grid.labelled(grid.nodes(spark, C).select("id"), fx.rects(spark), C)
    return links.resolved(_dense(spark, sf_dir), labels, B, 0, T)


@plan(f"""{_DENSE}, lab AS (SELECT id, CASE WHEN x BETWEEN 0 AND 6 AND y BETWEEN 2 AND 6 THEN 0 WHEN x BETWEEN 5 AND 9 AND y BETWEEN 1 AND 8 THEN 4 END AS r FROM node),
m AS (SELECT d.*, coalesce(a.r = b.r, false) AS inside FROM dense AS d LEFT JOIN lab AS a ON a.id = d.src LEFT JOIN lab AS b ON b.id = d.dst),
one AS (SELECT a.src, a.step, a.src AS other, a.step AS since, a.inside AS was, b.inside AS is_ FROM m AS a JOIN m AS b ON b.src = a.src AND b.step = a.step + 1 WHERE a.dst <> b.dst
  UNION ALL SELECT a.src, a.step, a.src, p.step, p.inside, b.inside FROM m AS a JOIN m AS b ON b.src = a.src AND b.step = a.step + 1 JOIN m AS p ON p.src = a.src AND p.step BETWEEN a.step - 3 AND a.step - 1 AND p.dst IS NOT NULL
    WHERE a.dst IS NULL AND b.dst IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m AS q WHERE q.src = a.src AND q.dst IS NOT NULL AND q.step > p.step AND q.step < a.step)
  UNION ALL SELECT a.src, a.step, o.src, a.step + 1, a.inside, o.inside FROM m AS a JOIN m AS b ON b.src = a.src AND b.step = a.step + 1 JOIN m AS o ON o.step = a.step + 1 AND o.dst = a.dst AND o.src <> a.src WHERE b.dst IS NULL),
gone AS (SELECT src, unnest(generate_series(greatest(0, step - 2), step)) AS step FROM one WHERE NOT was UNION SELECT other, unnest(generate_series(since, least(23, since + 2))) FROM one WHERE was AND NOT is_)
SELECT step, src, dst FROM dense WHERE dst IS NOT NULL AND (step, src) NOT IN (SELECT (step, src) FROM gone)""")
def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = grid.labelled(grid.nodes(spark, C).select("id"), fx.rects(spark), C)
    return links.resolved_ports(_dense(spark, sf_dir), labels, B, 0, T)


_PLAIN = f"""{_DENSE}, gone AS (SELECT src, unnest(generate_series(greatest(0, step - 2), step)) AS step FROM nxt WHERE dst IS NOT NULL AND new IS NOT NULL AND dst <> new),
kept AS (SELECT step, src, dst FROM dense WHERE dst IS NOT NULL AND (step, src) NOT IN (SELECT (step, src) FROM gone))"""


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nowhere = grid.nodes(spark, C).select("id", F.lit(-1).alias("region_id"))
    return links.resolved(_dense(spark, sf_dir), nowhere, B, 0, T)


@plan(f"{_PLAIN} SELECT step, src, dst FROM kept")
def resolve_conflicts_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(spark, sf_dir)


@plan(f"""{_PLAIN}, d2 AS (SELECT CAST(s AS INT) AS step, id AS src, kept.dst FROM node CROSS JOIN range(24) AS r(s) LEFT JOIN kept ON kept.step = s AND kept.src = id),
n2 AS (SELECT *, lead(dst) OVER (PARTITION BY src ORDER BY step) AS new FROM d2),
busy AS (SELECT DISTINCT step, src FROM kept UNION SELECT step, dst FROM kept),
e AS (SELECT step, src, dst FROM n2 WHERE dst IS NOT NULL AND new IS NULL AND step < 23),
g AS (SELECT e.step, e.src, e.dst, coalesce((SELECT min(b.step) FROM busy AS b WHERE b.step > e.step AND b.src IN (e.src, e.dst)), 24) - 4 AS last FROM e)
SELECT step, src, dst FROM kept UNION ALL SELECT CAST(unnest(generate_series(step + 1, last)) AS INT), src, dst FROM g WHERE last > step""")
def resolve_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _plain(spark, sf_dir)
    return kept.unionByName(links.idle_extension(links.filled(kept, spark, C, 0, T), B, T))


_EXTENDED = f"""{_PLAIN}, d2 AS (SELECT CAST(s AS INT) AS step, id AS src, kept.dst FROM node CROSS JOIN range(24) AS r(s) LEFT JOIN kept ON kept.step = s AND kept.src = id),
n2 AS (SELECT *, lead(dst) OVER (PARTITION BY src ORDER BY step) AS new FROM d2),
busy AS (SELECT DISTINCT step, src FROM kept UNION SELECT step, dst FROM kept),
e AS (SELECT step, src, dst FROM n2 WHERE dst IS NOT NULL AND new IS NULL AND step < 23),
g AS (SELECT e.step, e.src, e.dst, coalesce((SELECT min(b.step) FROM busy AS b WHERE b.step > e.step AND b.src IN (e.src, e.dst)), 24) - 4 AS last FROM e),
longer AS (SELECT step, src, dst FROM kept UNION ALL SELECT CAST(unnest(generate_series(step + 1, last)) AS INT), src, dst FROM g WHERE last > step)"""


@plan(f"""{_EXTENDED}, take AS (SELECT src AS taker, new AS dst, unnest(generate_series(greatest(0, step - 2), step)) AS step FROM nxt WHERE new IS NOT NULL AND dst IS DISTINCT FROM new AND next IS NOT NULL)
SELECT step, src, dst FROM longer AS k WHERE NOT EXISTS (SELECT 1 FROM take AS t WHERE t.step = k.step AND t.dst = k.dst AND t.taker <> k.src)""")
def resolve_with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.targets_freed(_dense(spark, sf_dir), resolve_and_extend(spark, sf_dir), B, 0)


@plan(f"""{_DENSE}, busy AS (SELECT DISTINCT step, src FROM dense WHERE dst IS NOT NULL UNION SELECT step, dst FROM dense WHERE dst IS NOT NULL),
e AS (SELECT step, src, dst FROM nxt WHERE dst IS NOT NULL AND new IS NULL AND step < 23),
g AS (SELECT e.step, e.src, e.dst, coalesce((SELECT min(b.step) FROM busy AS b WHERE b.step > e.step AND b.src IN (e.src, e.dst)), 24) - 4 AS last FROM e)
SELECT CAST(unnest(generate_series(step + 1, last)) AS INT) AS step, src, dst FROM g WHERE last > step""")
def idle_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.idle_extension(_dense(spark, sf_dir), B, T)


_MEMBERS = ", mem AS (SELECT step, gid, sat_id FROM gv WHERE gid IN (0, 4))"
_INTERNAL = f"""{_MEMBERS}, internal AS (SELECT a.step, a.gid, a.sat_id AS src, CAST(a.sat_id + 10 AS INT) AS dst FROM mem AS a JOIN mem AS b ON b.step = a.step AND b.gid = a.gid AND b.sat_id = a.sat_id + 10),
runs AS (SELECT gid, src, dst, CAST(min(step) AS INT) AS t_start, CAST(max(step) AS INT) AS t_end
         FROM (SELECT *, step - row_number() OVER (PARTITION BY gid, src, dst ORDER BY step) AS run FROM internal) GROUP BY gid, src, dst, run)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.groups(spark, sf_dir).where("gid IN (0, 4)")


@plan(f"{_INTERNAL} SELECT step, gid, src, dst FROM internal")
def region_internal_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.region_internal(_members(spark, sf_dir), C)


@plan(f"{_INTERNAL} SELECT gid, src, dst, t_start, t_end FROM runs")
def region_link_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_runs(links.region_internal(_members(spark, sf_dir), C))


_SKELETON = f"""{_INTERNAL}, walk AS (SELECT gid, src, dst, t_start, t_end, greatest(t_start, 1) AS est, row_number() OVER (PARTITION BY gid, src, dst ORDER BY t_start DESC) AS k FROM runs),
back AS (SELECT w.*, n.node, CASE WHEN NOT (EXISTS (SELECT 1 FROM mem AS m WHERE m.gid = w.gid AND m.sat_id = n.node AND m.step = w.est)) THEN 0
  WHEN w.est - 1 <= 0 OR NOT (EXISTS (SELECT 1 FROM mem AS m WHERE m.gid = w.gid AND m.sat_id = n.node AND m.step = w.est - 1)) THEN 0
  WHEN w.est - 2 <= 0 OR NOT (EXISTS (SELECT 1 FROM mem AS m WHERE m.gid = w.gid AND m.sat_id = n.node AND m.step = w.est - 2)) THEN 1 ELSE 2 END AS d
  FROM walk AS w, LATERAL (SELECT w.src AS node UNION ALL SELECT w.dst) AS n),
begun AS (SELECT gid, src, dst, t_start, t_end, k, CAST(any_value(est) - max(d) AS INT) AS b FROM back GROUP BY gid, src, dst, t_start, t_end, k),
fold AS (SELECT gid, src, dst, k, b, CAST(t_end AS INT) AS t_end, t_end - b >= 2 AND t_end >= t_start AS keep, CASE WHEN t_end - b >= 2 AND t_end >= t_start THEN b ELSE 1000000000 END AS nxt FROM begun WHERE k = 1
  UNION ALL SELECT r.gid, r.src, r.dst, r.k, r.b, CAST(least(r.t_end, f.nxt - 1) AS INT), least(r.t_end, f.nxt - 1) >= r.t_start AND least(r.t_end, f.nxt - 1) - r.b >= 2,
  CASE WHEN least(r.t_end, f.nxt - 1) >= r.t_start AND least(r.t_end, f.nxt - 1) - r.b >= 2 THEN r.b ELSE f.nxt END
  FROM fold AS f JOIN begun AS r ON r.gid = f.gid AND r.src = f.src AND r.dst = f.dst AND r.k = f.k + 1),
skel AS (SELECT gid, src, dst, b AS t_setup, CAST(b + 2 AS INT) AS t_work, t_end FROM fold WHERE keep)"""


def _skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.region_skeleton(_members(spark, sf_dir), C, 2)


@plan(f"{_SKELETON} SELECT gid, src, dst, t_setup, t_work, t_end FROM skel")
def region_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skeleton(spark, sf_dir)


@plan("""SELECT CAST(s AS INT) AS t, id AS src, CAST(id + 10 AS INT) AS dst, CASE WHEN s = 0 THEN 0 WHEN s < 2 THEN 1 ELSE 2 END AS state, CAST(greatest(s, 2) AS INT) AS peer_t
FROM node, range(24) AS r(s) WHERE x < 9""")
def grid_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = grid.right_links(spark, C).select("src", "dst", F.lit(0).alias("t_setup"), F.lit(2).alias("t_work"), F.lit(T - 1).alias("t_end"))
    return links.life_cycle(whole)


# States of the skeleton of group 0, in which some rows are lost, so that checks have something to find.
_STATES = f"""{_SKELETON}, life AS (SELECT CAST(t AS INT) AS t, src, dst, CASE WHEN t = t_setup THEN 0 WHEN t < t_work THEN 1 ELSE 2 END AS state, CAST(greatest(t, t_work) AS INT) AS peer_t
  FROM (SELECT *, unnest(generate_series(t_setup, t_end)) AS t FROM skel WHERE gid = 0)),
st AS (SELECT * FROM life WHERE (src * 3 + t) % 11 <> 0),
lv AS (SELECT t, dst AS node, src AS left_src FROM life WHERE (dst + t) % 7 <> 0),
ds AS (SELECT CAST(s AS INT) AS t, id AS src, dst, coalesce(state, -1) AS state, peer_t FROM node CROSS JOIN range(24) AS r(s) LEFT JOIN st ON st.t = s AND st.src = id)"""


def _life(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.life_cycle(_skeleton(spark, sf_dir).where("gid = 0"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life(spark, sf_dir).where("(src * 3 + t) % 11 <> 0")


def _left_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _life(spark, sf_dir).where("(dst + t) % 7 <> 0").select("t", F.col("dst").alias("node"), F.col("src").alias("left_src"))


def _dense_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.dense_states(_states(spark, sf_dir), spark, C, T)


@plan(f"""{_STATES}, g AS (SELECT *, sum(CASE WHEN state IN (0, -1) THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY t) AS run FROM ds),
h AS (SELECT *, first_value(state) OVER w AS s0, first_value(dst) OVER w AS peer FROM g WINDOW w AS (PARTITION BY src, run ORDER BY t))
SELECT t, src, peer AS dst FROM h WHERE s0 = 0 AND state = 2""")
def decode_working_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.working_edges(_dense_states(spark, sf_dir))


@plan(f"{_STATES} SELECT lv.t, left_src AS src, node AS dst FROM lv JOIN st ON st.t = lv.t AND st.src = left_src AND st.state = 2")
def decode_left_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.left_working(_states(spark, sf_dir), _left_view(spark, sf_dir))


@plan(f"{_STATES} SELECT t, src, dst, peer_t FROM st WHERE state = 0")
def setup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.setup_events(_states(spark, sf_dir))


@plan(f"{_STATES} SELECT t, src, min(CASE WHEN state = 0 THEN t END) OVER (PARTITION BY src ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_t FROM ds")
def next_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.next_setup(_dense_states(spark, sf_dir))


@plan(f"""{_STATES} SELECT a.t, a.src, NOT EXISTS (SELECT 1 FROM st WHERE st.src = a.src AND st.t BETWEEN a.t AND a.t + 2) AND a.t + 2 < 24 AS can_start,
NOT EXISTS (SELECT 1 FROM lv WHERE lv.node = a.src AND lv.t BETWEEN a.t - 2 AND a.t) AS can_end FROM ds AS a""")
def free_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _left_view(spark, sf_dir).select("t", F.col("node").alias("dst"))
    return links.free_ports(_dense_states(spark, sf_dir), left, 2, T)


# The same with states, peers and times that are wrong in some rows, so that every rule is broken somewhere.
_WRONG = f"""{_STATES}, wrong AS (SELECT t, src, CAST(CASE WHEN (src + 2 * t) % 17 = 0 THEN dst + 1 ELSE dst END AS INT) AS dst,
  CAST(CASE WHEN (src + t) % 5 = 0 THEN (state + 1) % 3 ELSE state END AS INT) AS state, CAST(CASE WHEN (src * 2 + t) % 7 = 0 THEN peer_t + 2 ELSE peer_t END AS INT) AS peer_t FROM st),
wds AS (SELECT CAST(s AS INT) AS t, id AS src, coalesce(state, -1) AS state FROM node CROSS JOIN range(24) AS r(s) LEFT JOIN wrong ON wrong.t = s AND wrong.src = id)"""


def _wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, src = F.col("t"), F.col("src")
    return _states(spark, sf_dir).select(
        "t",
        "src",
        F.when((src + 2 * t) % 17 == 0, F.col("dst") + 1).otherwise(F.col("dst")).cast("int").alias("dst"),
        F.when((src + t) % 5 == 0, (F.col("state") + 1) % 3).otherwise(F.col("state")).cast("int").alias("state"),
        F.when((src * 2 + t) % 7 == 0, F.col("peer_t") + 2).otherwise(F.col("peer_t")).cast("int").alias("peer_t"),
    )


@plan(f"""{_WRONG}, rule(state, near, side) AS (VALUES (-1, -1, 0), (-1, 2, 0), (0, -1, 0), (0, 2, 0), (1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 2, 0),
  (-1, -1, 1), (-1, 0, 1), (0, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (2, -1, 1), (2, 0, 1))
SELECT a.t, a.src, a.state, CASE WHEN b.t < a.t THEN 'wrong before' ELSE 'wrong after' END AS violation FROM wds AS a JOIN wds AS b ON b.src = a.src AND abs(b.t - a.t) = 1
WHERE NOT EXISTS (SELECT 1 FROM rule WHERE rule.state = a.state AND rule.near = b.state AND rule.side = CASE WHEN b.t < a.t THEN 0 ELSE 1 END)
UNION ALL SELECT t, src, state, 'being set up at the first step' FROM wds WHERE t = 0 AND state = 1 UNION ALL SELECT t, src, state, 'begins at the last step' FROM wds WHERE t = 23 AND state = 0""")
def check_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.state_violations(links.dense_states(_wrong(spark, sf_dir), spark, C, T))


@plan(f"""{_WRONG}, v AS (SELECT lv.t, lv.node, lv.left_src, coalesce(w.state, -1) AS state, w.dst, w.peer_t FROM lv LEFT JOIN wrong AS w ON w.t = lv.t AND w.src = lv.left_src)
SELECT t, node, left_src, state, 'left node has no link' AS violation FROM v WHERE state = -1
UNION ALL SELECT t, node, left_src, state, 'set-up names another place' FROM v WHERE state = 0 AND (dst, peer_t) <> (node, t + 2)
UNION ALL SELECT t, node, left_src, state, 'set-up is with another node' FROM v WHERE state = 1 AND dst <> node
UNION ALL SELECT t, node, left_src, state, 'set-up ends too late' FROM v WHERE state = 1 AND NOT peer_t - t < 2
UNION ALL SELECT t, node, left_src, state, 'link is with another place' FROM v WHERE state = 2 AND (dst, peer_t) <> (node, t)""")
def check_left_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.left_violations(_wrong(spark, sf_dir), _left_view(spark, sf_dir), 2)


@plan(f"{_STATES} SELECT step, gid, src, dst FROM internal WHERE gid = 0 AND step >= 2 AND (step, src, dst) NOT IN (SELECT (t, src, dst) FROM st WHERE state = 2)")
def check_region_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.region_violations(_members(spark, sf_dir).where("gid = 0"), _states(spark, sf_dir), C).select("step", "gid", "src", "dst")


@plan(f"""{_STATES}, a AS (SELECT t, src, dst FROM st WHERE state = 2), b AS (SELECT t, left_src AS src, node AS dst FROM lv)
SELECT t, src, dst, 'right' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT t, src, dst, 'left' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def topology_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _states(spark, sf_dir).where("state = 2").select("t", "src", "dst")
    left = _left_view(spark, sf_dir).select("t", F.col("left_src").alias("src"), F.col("node").alias("dst"))
    return links.difference(right, left)


@plan("""SELECT step, src, dst FROM link WHERE step >= 12 UNION ALL SELECT CAST(s AS INT), id, CAST(id + 10 AS INT) FROM node, range(16) AS r(s)
WHERE x < 9 AND (s < 12 OR (CAST(s AS INT), id) NOT IN (SELECT (step, src) FROM link))""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = grid.replicate(grid.right_links(spark, C), 0, 16)
    return links.merged(first, fx.links(spark, sf_dir).where("step >= 12"), ["step", "src"])


_ZERO = f"{_SKELETON}, z AS (SELECT src, dst, t_setup, t_work, t_end FROM skel WHERE gid = 0)"


def _zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _skeleton(spark, sf_dir).where("gid = 0").drop("gid")


@plan(f"""{_ZERO} SELECT src, dst, t_setup, t_work, CAST(greatest(t_end, least(coalesce(lead(t_setup) OVER (PARTITION BY src ORDER BY t_setup), 24), coalesce(lead(t_setup) OVER (PARTITION BY dst ORDER BY t_setup), 24)) - 1) AS INT) AS t_end FROM z""")
def maintained_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extended(_zero(spark, sf_dir), T)


@plan(f"{_ZERO} SELECT * FROM z WHERE NOT (src % 3 = 0 AND t_setup <= 10 AND t_end >= 10)")
def cleared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = grid.nodes(spark, C).where("id % 3 = 0").select(F.col("id").alias("src"), F.lit(10).alias("t"))
    return links.cleared(_zero(spark, sf_dir), picks)


@plan(f"""{_ZERO}, w AS (SELECT id AS src, CAST(id + 20 AS INT) AS dst, CAST(id % 9 AS INT) AS t FROM node WHERE x < 8 AND id % 2 = 0),
f AS (SELECT w.*, least(coalesce((SELECT min(t_setup) FROM z WHERE z.src = w.src AND w.t <= z.t_end), 24), coalesce((SELECT min(t_setup) FROM z WHERE z.dst = w.dst AND w.t <= z.t_end), 24)) - 1 AS e FROM w)
SELECT * FROM z UNION ALL SELECT src, dst, t, CAST(t + 2 AS INT), CAST(e AS INT) FROM f WHERE e - t >= 2""")
def established_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    wishes = grid.nodes(spark, C).where("x < 8 AND id % 2 = 0").select(F.col("id").alias("src"), (F.col("id") + 20).cast("int").alias("dst"), (F.col("id") % 9).cast("int").alias("t"))
    return links.established(_zero(spark, sf_dir), wishes, 2, T)
