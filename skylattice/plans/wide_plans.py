"""Queries on the large constellation, whose steps come from full timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.grid import LARGE
from skylattice.operators import grid, paths, visibility, wide_paths
from skylattice.plans.registry import plan
from skylattice.sources.shared import written
from skylattice.sources.tables import STATION_GROUPS, parquet, station_dimension, visibility_between

C = LARGE
#: The events' first instant, a day, and the interval of the scan query.
ORIGIN, DAY, FROM, UNTIL = "2024-01-01 00:00:00", 86_400, "2024-01-08 12:00:00", "2024-01-22 00:00:00"
#: Rectangles with a motif: group, first and last plane, first and last slot, kind of motif.
RECTS = ((0, 0, 11, 4, 22, 0), (4, 8, 17, 10, 31, 1))

WITH = """
WITH RECURSIVE seen AS (
  SELECT DISTINCT CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 // {seconds} AS INT) AS step, CAST(event_id % 20 AS INT) AS station_id, user_id
  FROM events WHERE {interval}),
vis AS (SELECT DISTINCT step, station_id, CAST((station_id // 2 + user_id % 2) % 18 * 36 + (station_id * 3 + step + user_id % 3) % 36 AS INT) AS sat_id FROM seen),
gv AS (SELECT DISTINCT step, sat_id, CASE WHEN station_id <= 3 THEN 0 WHEN station_id <= 8 THEN 1 WHEN station_id = 9 THEN 2
         WHEN station_id = 10 THEN 3 WHEN station_id <= 14 THEN 4 WHEN station_id <= 16 THEN 5 ELSE 6 END AS gid FROM vis)"""
_INTERVAL = WITH.format(seconds=600, interval=f"ts >= TIMESTAMP '{FROM}' AND ts < TIMESTAMP '{UNTIL}'")
_DAYS = WITH.format(seconds=DAY, interval="true")

_TOPO = """, node AS (SELECT CAST(range AS INT) AS id, CAST(range // 36 AS INT) AS x, CAST(range % 36 AS INT) AS y FROM range(648)),
off AS (SELECT step, CAST(CASE WHEN min(sat_id % 36) <> 0 THEN max(sat_id % 36) ELSE max(CASE WHEN sat_id % 36 <= 5 THEN sat_id % 36 END) END AS INT) AS offs FROM gv WHERE gid = 0 GROUP BY step),
ring AS (SELECT id AS src, CAST(x * 36 + (y + d + 36) % 36 AS INT) AS dst FROM node, (VALUES (1), (-1)) AS v(d)),
rect(gid, xmin, xmax, ymin, ymax, option) AS (VALUES (0, 0, 11, 4, 22, 0), (4, 8, 17, 10, 31, 1)),
motif AS (SELECT src, max(dst) AS dst FROM (SELECT n.id AS src, CAST((n.x + 1) * 36 + CASE WHEN option = 0 THEN n.y ELSE (n.y + 35) % 36 END AS INT) AS dst, n.x + 1 AS nx, CASE WHEN option = 0 THEN n.y ELSE (n.y + 35) % 36 END AS ny, r.*
            FROM node AS n, rect AS r WHERE n.x BETWEEN xmin AND xmax AND n.y BETWEEN ymin AND ymax) WHERE nx BETWEEN xmin AND xmax AND ny BETWEEN ymin AND ymax GROUP BY src),
link AS (SELECT step, CAST(src // 36 * 36 + (src % 36 + offs + 1) % 36 AS INT) AS src, CAST(dst // 36 * 36 + (dst % 36 + offs + 1) % 36 AS INT) AS dst FROM motif, off),
topo AS (SELECT step, src, dst FROM link UNION SELECT step, dst, src FROM link UNION SELECT step, src, dst FROM off, ring),
ends AS (SELECT step, sat_id AS node, gid FROM gv WHERE gid IN (0, 4) AND step IN (SELECT step FROM off))"""
# Distances from the ends of a group, and numbers of shortest paths, a level a round.
_REACH = """, d{g} AS (SELECT step, node AS src, node, 0 AS h FROM ends WHERE gid = {g} UNION SELECT a.step, a.src, t.dst, a.h + 1 FROM d{g} AS a JOIN topo AS t ON t.step = a.step AND t.src = a.node WHERE a.h < {most}),
h{g} AS (SELECT step, src, node, min(h) AS h FROM d{g} GROUP BY step, src, node),
p{g} AS (SELECT step, src, node, h, CAST(1 AS DOUBLE) AS n FROM h{g} WHERE h = 0
  UNION ALL SELECT p.step, p.src, t.dst, q.h, sum(p.n) FROM p{g} AS p JOIN topo AS t ON t.step = p.step AND t.src = p.node JOIN h{g} AS q ON q.step = p.step AND q.src = p.src AND q.node = t.dst AND q.h = p.h + 1 GROUP BY p.step, p.src, t.dst, q.h)"""
#: The small fixture's groups, with names of the parts below.
SMALL_ENDS = ", topo0 AS (SELECT step, src, dst FROM link UNION SELECT step, dst, src FROM link UNION SELECT step, src, dst FROM off, ring), topo AS (SELECT * FROM topo0), ends AS (SELECT step, sat_id AS node, gid FROM gv WHERE gid IN (0, 4))"
THROUGH = """, pair AS (SELECT s.step, s.src, s.node AS dst, s.h, s.n FROM p0 AS s JOIN ends AS e ON e.gid = 4 AND e.step = s.step AND e.node = s.node),
via AS (SELECT a.step, a.node, sum(a.n * b.n / pair.n) AS score FROM pair JOIN p0 AS a ON a.step = pair.step AND a.src = pair.src JOIN p4 AS b ON b.step = pair.step AND b.src = pair.dst AND b.node = a.node AND a.h + b.h = pair.h
        GROUP BY a.step, a.node),
every AS (SELECT DISTINCT step, src AS node FROM topo UNION SELECT step, node FROM ends),
score AS (SELECT e.step, e.node, CASE WHEN (e.step, e.node) IN (SELECT (step, node) FROM ends) THEN 0 ELSE coalesce(v.score, 0) END AS score FROM every AS e LEFT JOIN via AS v ON v.step = e.step AND v.node = e.node)"""


def reach(most: int) -> str:
    return _REACH.format(g=0, most=most) + _REACH.format(g=4, most=most)


def groups(spark: SparkSession, sf_dir: str, seconds: int, first: str | None = None, until: str | None = None) -> DataFrame:
    seen = visibility_between(parquet(spark, sf_dir, "events"), C, ORIGIN, seconds, first, until)
    return visibility.grouped(seen, station_dimension(spark, STATION_GROUPS, "gid"), "gid")


def topology(members: DataFrame) -> DataFrame:
    """Each step's links, both ways: the motif in the frame of the step's group 0, and the rings."""
    steps = written(visibility.group_offsets(members, C))
    rects = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("gid", "xmin", "xmax", "ymin", "ymax", "option"), r))) for r in RECTS))
    placed = grid.motif_edges(steps.select("step", F.inline(rects)), C, keep=["step"]).groupBy("step", "src").agg(F.max("dst").alias("dst"))
    across = visibility.to_frame(placed, steps, C, "src", "dst", raw=True).select("step", "src", "dst")
    return grid.bidirectional(across.unionByName(grid.ring_edges_at(steps.select("step"), C)))


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Names of the days' topologies, their edges, and the members of groups 0 and 4."""
    members = written(groups(spark, sf_dir, DAY))
    names, graphs = paths.distinct_topologies(written(topology(members)))
    return written(names), written(graphs), members.where("gid IN (0, 4)")


@plan(f"{_INTERVAL} SELECT step, gid, sat_id FROM gv", prefix="")
def interval_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is seen in an interval of two weeks, in steps of ten minutes; the interval's bounds reach the scan."""
    return groups(spark, sf_dir, 600, FROM, UNTIL)


@plan(f"{_DAYS}{_TOPO}{_REACH.format(g=0, most=40)} SELECT s.step, s.src, s.node AS dst, CAST(s.h AS INT) AS hops FROM h0 AS s JOIN ends AS e ON e.gid = 4 AND e.step = s.step AND e.node = s.node", prefix="")
def wide_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, graphs, members = _graphs(spark, sf_dir)
    pairs = paths.region_pairs(members, 0, 4).join(names, "step")
    found = wide_paths.hops_by_rounds(graphs, pairs.select("topo", "src", "dst"))
    return pairs.join(found, ["topo", "src", "dst"]).select("step", "src", "dst", "hops")


@plan(f"{_DAYS}{_TOPO}{reach(40)}{THROUGH} SELECT step, node, round(score, 6) AS score FROM score", prefix="")
def wide_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    # ends differ from day to day, so each day is a graph of its own
    names, graphs, members = _graphs(spark, sf_dir)
    days = names.join(graphs, "topo").select(F.col("step").cast("long").alias("topo"), "src", "dst")
    ends = members.join(names, "step").select(F.col("step").cast("long").alias("topo"), F.col("sat_id").alias("node"), F.when(F.col("gid") == 0, "source").otherwise("target").alias("role"))
    found = wide_paths.betweenness_in_blocks(days, ends.distinct())
    return found.select(F.col("topo").cast("int").alias("step"), "node", F.round("score", 6).alias("score"))


_STICK = WITH.format(seconds=600, interval="true") + """, span AS (SELECT gid, step, CAST(min(sat_id // 36) AS INT) AS lo, CAST(max(sat_id // 36) AS INT) AS hi, row_number() OVER (PARTITION BY gid ORDER BY step) AS k FROM gv GROUP BY gid, step),
fold AS (SELECT gid, step, k, lo AS x_left, false AS moved FROM span WHERE k = 1
UNION ALL SELECT s.gid, s.step, s.k, CASE WHEN f.x_left + 2 <= s.hi THEN s.lo ELSE f.x_left END, f.x_left + 2 <= s.hi FROM fold AS f JOIN span AS s ON s.gid = f.gid AND s.k = f.k + 1)"""


@plan(f"{_STICK} SELECT gid, step, x_left, moved FROM fold", prefix="")
def wide_sticky_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole history in steps of ten minutes: thousands of steps a group."""
    return visibility.sticky_windows(groups(spark, sf_dir, 600), C, width=2)
