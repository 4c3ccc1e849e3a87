"""Queries on the grid and on visibility, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.grid import LARGE, node_id
from skylattice.operators import grid, visibility
from skylattice.plans import fixtures as fx
from skylattice.plans.registry import plan

C = fx.C


@plan("SELECT step, gid, sat_id FROM gv")
def group_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.groups(spark, sf_dir)


@plan("""SELECT DISTINCT step, sat_id, CASE WHEN station_id <= 8 THEN 0 WHEN station_id = 9 THEN 1 WHEN station_id = 10 THEN 2
WHEN station_id <= 14 THEN 3 WHEN station_id <= 16 THEN 4 ELSE 5 END AS region_id FROM vis WHERE station_id <= 18 AND step BETWEEN 2 AND 20""")
def region_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.regions(spark, sf_dir, 2, 20)


@plan("SELECT x, y, CAST(t AS INT) AS t, -1 AS state, CAST(-1 AS DOUBLE) AS importance FROM node, range(24) AS r(t)")
def grid_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_nodes(spark, C, 0, fx.STEPS)


@plan("SELECT step, id, x, y, CAST(x * 10 + y AS INT) AS back FROM sn")
def node_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the satellites that are seen at each step."""
    return fx.seen_nodes(spark, sf_dir).withColumn("back", node_id("x", "y", C))


@plan("SELECT step, count(DISTINCT sat_id) AS n_sats FROM gv GROUP BY step")
def coverage_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.coverage(fx.groups(spark, sf_dir))


@plan("SELECT step, sat_id, min(gid) AS gid FROM gv GROUP BY step, sat_id")
def satellite_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.owners(fx.groups(spark, sf_dir))


@plan('SELECT step, offs AS "offset" FROM off')
def group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.offsets(spark, sf_dir)


@plan("SELECT step, gid, CAST(sat_id // 10 * 10 + (sat_id % 10 - offs + 19) % 10 AS INT) AS sat_id FROM gv JOIN off USING (step)")
def normalize_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.to_frame(fx.groups(spark, sf_dir), fx.offsets(spark, sf_dir), C, "sat_id").select("step", "gid", "sat_id")


@plan("SELECT step, src, dst FROM link")
def denormalize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.links(spark, sf_dir)


@plan("""SELECT step, CAST(src // 10 * 10 + (src % 10 - offs + 19) % 10 AS INT) AS src, CAST(dst // 10 * 10 + (dst % 10 - offs + 19) % 10 AS INT) AS dst
FROM link JOIN off USING (step)""")
def normalize_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.to_frame(fx.links(spark, sf_dir), fx.offsets(spark, sf_dir), C, "src", "dst").select("step", "src", "dst")


def _bounds(seam: str) -> str:
    parts = []
    for side in ("left", "right"):
        inside = {"left": "x < 5", "right": "x >= 5"}[side]
        for name, f, v in (("xmin", "min", "x"), ("xmax", "max", "x"), ("ymin", "min", "y"), ("ymax", "max", "y")):
            whole = f"ELSE {f}({v}) " if side == "left" else ""
            parts.append(f"CAST(CASE WHEN {seam} THEN {f}(CASE WHEN {inside} THEN {v} END) {whole}END AS INT) AS {side}_{name}")
    return ", ".join(parts)


_SEAM = "min(x) = 0 AND max(x) = 9"


@plan(f"SELECT gid, {_bounds(_SEAM)} FROM (SELECT *, sat_id // 10 AS x, sat_id % 10 AS y FROM gv) WHERE step BETWEEN 3 AND 9 GROUP BY gid")
def interval_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.interval_envelope(fx.groups(spark, sf_dir), C, 3, 9)


@plan(f"""SELECT CAST(s.step AS INT) AS step, {_bounds(_SEAM)} FROM range(26) AS s(step)
LEFT JOIN (SELECT *, sat_id // 10 AS x, sat_id % 10 AS y FROM gv WHERE gid = 3) AS g ON g.step = s.step GROUP BY s.step""")
def envelope_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.envelope_trace(fx.groups(spark, sf_dir), C, 3, 0, 25)


_INTERVALS = "VALUES (0, 7), (8, 15), (14, 23), (30, 31) AS t(start_step, end_step)"
_BOXES = """boxes AS (SELECT a, b, g.gid, CAST(coalesce(min(sat_id // 10), -1) AS INT) AS xmin, CAST(coalesce(max(sat_id // 10), -1) AS INT) AS xmax,
CAST(coalesce(min(sat_id % 10), -1) AS INT) AS ymin, CAST(coalesce(max(sat_id % 10), -1) AS INT) AS ymax
FROM (VALUES (0, 7), (8, 15), (14, 23), (30, 31)) AS t(a, b), (SELECT DISTINCT gid FROM gv) AS g LEFT JOIN gv ON gv.gid = g.gid AND gv.step BETWEEN a AND b
GROUP BY a, b, g.gid)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.envelope_by_interval(fx.groups(spark, sf_dir), spark.sql(f"SELECT * FROM {_INTERVALS}"), C)


@plan(f", {_BOXES} SELECT a AS start_step, b AS end_step, gid, xmin, xmax, ymin, ymax FROM boxes")
def envelope_by_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir)


@plan(f""", {_BOXES} SELECT CAST(s AS INT) AS step, gid, a AS start_step, b AS end_step, xmin, xmax, ymin, ymax
FROM range(28) AS r(s) JOIN boxes ON s BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY s, gid ORDER BY a, b) = 1""")
def envelope_at_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(28).select(F.col("id").cast("int").alias("step"))
    return visibility.at_step(steps, _boxes(spark, sf_dir)).select("step", "gid", "start_step", "end_step", "xmin", "xmax", "ymin", "ymax")


_SWAPPED = "VALUES (4, 9, 5, 1, 8), (0, 0, 6, 6, 2), (7, 6, 6, 0, 9) AS t(gid, xmin, xmax, ymin, ymax)"
_CELLS = """cells AS (SELECT DISTINCT gid, id FROM node, (VALUES (4, 9, 5, 1, 8), (0, 0, 6, 6, 2), (7, 6, 6, 0, 9)) AS t(gid, xmin, xmax, ymin, ymax)
WHERE x BETWEEN least(xmin, xmax) AND greatest(xmin, xmax) AND y BETWEEN least(ymin, ymax) AND greatest(ymin, ymax))"""


@plan(f", {_BOXES} SELECT DISTINCT gid, id FROM node JOIN boxes ON xmin >= 0 AND x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")
def rect_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The satellites in the groups' boxes."""
    return grid.rect_nodes(_boxes(spark, sf_dir).where("xmin >= 0").select("gid", "xmin", "xmax", "ymin", "ymax"), C)


@plan(f", {_CELLS} SELECT step, sat_id AS id, min(cells.gid) AS gid FROM gv JOIN cells ON cells.id = sat_id GROUP BY step, sat_id")
def rect_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = fx.groups(spark, sf_dir).select("step", F.col("sat_id").alias("id")).distinct()
    return grid.membership(points, spark.sql(f"SELECT * FROM {_SWAPPED}"), C)


@plan(f", {_CELLS} SELECT step, sn.id, x, y, coalesce(min(gid), -1) AS region_id FROM sn LEFT JOIN cells ON cells.id = sn.id GROUP BY step, sn.id, x, y")
def label_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.labelled(fx.seen_nodes(spark, sf_dir), spark.sql(f"SELECT * FROM {_SWAPPED}"), C)


@plan(""", p AS (SELECT DISTINCT step, gid, CAST(sat_id // 10 AS INT) AS x FROM gv),
q AS (SELECT *, x - row_number() OVER (PARTITION BY step, gid ORDER BY x) AS run, min(x) OVER (PARTITION BY step, gid) AS lo, max(x) OVER (PARTITION BY step, gid) AS hi FROM p),
k AS (SELECT *, lo = 0 AND hi = 9 AS seam, min(run) OVER (PARTITION BY step, gid) AS f, max(run) OVER (PARTITION BY step, gid) AS l FROM q),
b AS (SELECT step, gid, x, 0 AS block FROM k WHERE NOT seam OR run = f UNION ALL SELECT step, gid, x, 1 FROM k WHERE seam AND run = l),
r AS (SELECT DISTINCT b.step, b.gid, block, b.x, gv.sat_id % 10 AS y FROM b JOIN gv ON gv.step = b.step AND gv.gid = b.gid AND gv.sat_id // 10 = b.x),
ys AS (SELECT DISTINCT step, gid, block, y FROM r),
gap AS (SELECT step, gid, block, coalesce(lead(y) OVER (PARTITION BY step, gid, block ORDER BY y), min(y) OVER (PARTITION BY step, gid, block) + 10) - y AS g FROM ys),
w AS (SELECT step, gid, block, CAST(11 - max(g) AS INT) AS width FROM gap GROUP BY ALL)
SELECT step, gid, block, CAST(max(x) - min(x) + 1 AS INT) AS length, any_value(width) AS width FROM r JOIN w USING (step, gid, block) GROUP BY step, gid, block""")
def block_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.block_extent(fx.groups(spark, sf_dir), C)


@plan("SELECT step, src, dst FROM sn JOIN ring ON src = id")
def intra_plane_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring links of the satellites that are seen at each step."""
    return grid.ring_edges_of(fx.seen_nodes(spark, sf_dir), ["step"], C)


_EDGES = "topo AS (SELECT step, src, dst FROM link UNION SELECT step, dst, src FROM link UNION SELECT step, src, dst FROM off, ring UNION SELECT step, dst, src FROM off, ring)"
_GRID = "grid AS (SELECT src, dst FROM ring WHERE src < 90 UNION ALL SELECT id, CAST(id + 10 AS INT) FROM node WHERE x < 9)"


@plan(f", {_GRID} SELECT step, src, dst FROM sn JOIN grid ON src = id")
def grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring links and links to the next plane of the satellites that are seen at each step."""
    return grid.grid_edges_of(fx.seen_nodes(spark, sf_dir), ["step"], C)


@plan(
    """WITH n AS (SELECT CAST(range AS INT) AS id, range // 36 AS x, range % 36 AS y FROM range(648))
SELECT id AS src, CAST(x * 36 + (y + d + 36) % 36 AS INT) AS dst FROM n, (VALUES (1), (-1)) AS v(d) WHERE x < 17
UNION ALL SELECT id, CAST((x + 1) * 36 + CASE WHEN y BETWEEN 14 AND 31 THEN y + 2 ELSE y END AS INT) FROM n WHERE x < 17 AND y NOT IN (30, 31)""",
    prefix="",
)
def banded_motif_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.banded_motif(spark, LARGE)


@plan("SELECT src, dst FROM motif")
def motif_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.motif_edges(fx.rects(spark), C)


@plan("SELECT CAST(s AS INT) AS step, src, dst FROM motif, range(5, 12) AS r(s)")
def replicate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.replicate(grid.motif_edges(fx.rects(spark), C), 5, 12)


_CAND = """cand AS (SELECT id AS src, k, CAST((x + dx) * 10 + y + dy AS INT) AS dst FROM node, (VALUES (0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 2, 0)) AS v(k, dx, dy)
WHERE x + dx < 10 AND y + dy BETWEEN 0 AND 9)"""


@plan(f', {_CAND}, r AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY k) - 1 AS INT) AS "rank", dst FROM cand) SELECT step, src, "rank", dst FROM r JOIN sn ON id = src')
def link_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the satellites that are seen at each step."""
    return fx.seen_nodes(spark, sf_dir).select("step", F.col("id").alias("src")).join(grid.candidates(spark, C), "src").select("step", "src", "rank", "dst")


@plan(f""", {_CAND},
forced AS (SELECT DISTINCT a.step, a.sat_id AS src, CAST(a.sat_id + 10 AS INT) AS dst FROM gv AS a JOIN gv AS b ON a.step = b.step AND a.gid = b.gid AND b.sat_id = a.sat_id + 10
           WHERE a.gid IN (0, 4)),
steps AS (SELECT DISTINCT step FROM gv WHERE gid IN (0, 4))
SELECT step, src, dst, true AS forced FROM forced UNION ALL
SELECT step, src, dst, false FROM cand, steps WHERE (step, src) NOT IN (SELECT (step, src) FROM forced) AND (step, dst) NOT IN (SELECT (step, dst) FROM forced)""")
def potential_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.potential_edges(fx.groups(spark, sf_dir).where("gid IN (0, 4)"), spark, C)


@plan(f", {_EDGES} SELECT step, src, dst FROM topo WHERE src // 10 <> dst // 10")
def inter_plane_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.inter_plane(fx.topology(spark, sf_dir), C)


@plan("SELECT step, src, dst FROM link UNION SELECT step, dst, src FROM link")
def bidirectional_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.bidirectional(fx.links(spark, sf_dir))




@plan(f", {_EDGES} SELECT step, src, dst FROM topo")
def all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.topology(spark, sf_dir)


@plan(f""", {_CAND} SELECT step, src, dst, src // 10 = dst // 10 AS intra, src % 10 = dst % 10 AND abs(src // 10 - dst // 10) > 1 AS curved
FROM (SELECT src, dst FROM cand UNION ALL SELECT src, dst FROM ring) JOIN sn ON id = src""")
def classify_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possible links of the satellites that are seen at each step."""
    nodes = fx.seen_nodes(spark, sf_dir)
    across = nodes.select("step", F.col("id").alias("src")).join(grid.candidates(spark, C), "src").select("step", "src", "dst")
    return grid.classified(across.unionByName(grid.ring_edges_of(nodes, ["step"], C)), C)


@plan("SELECT step AS layer, id, y AS px, x AS py, CAST(step * 10 AS INT) AS pz FROM sn")
def layer_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer a step, with the satellites that are seen then."""
    return grid.layer_coordinates_of(fx.seen_nodes(spark, sf_dir).withColumnRenamed("step", "layer"))


_FLOW = "flow AS (SELECT step, src, dst, 1 AS cost, c AS cap FROM topo, (VALUES (100), (50)) AS v(c) WHERE c = 50 OR src // 10 = dst // 10)"


@plan(f", {_EDGES}, {_FLOW} SELECT step, src, dst, cost, cap FROM flow")
def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.flow_edges(fx.topology(spark, sf_dir), C, keep=["step"])


@plan(f""", {_EDGES}, {_FLOW} SELECT step, src, dst, cost, cap FROM flow UNION ALL SELECT step, -1, sat_id, 0, 10 FROM gv WHERE gid = 0
UNION ALL SELECT step, sat_id, -2, 0, 1000000000 FROM gv WHERE gid = 4""")
def super_node_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the satellites of group 0 to those of group 4, at each step."""
    members = fx.groups(spark, sf_dir)
    sources = members.where("gid = 0").select("step", F.col("sat_id").alias("node"), F.lit(10).alias("demand"))
    flow = grid.flow_edges(fx.topology(spark, sf_dir), C, keep=["step"])
    return grid.with_super_nodes(flow, sources, members.where("gid = 4").select("step", F.col("sat_id").alias("node")), keep=["step"])


_SPAN = "span AS (SELECT gid, step, CAST(min(sat_id // 10) AS INT) AS lo, CAST(max(sat_id // 10) AS INT) AS hi, row_number() OVER (PARTITION BY gid ORDER BY step) AS k FROM gv GROUP BY gid, step)"
_STICK = f""", {_SPAN},
fold AS (SELECT gid, step, k, lo AS x_left, false AS moved FROM span WHERE k = 1
UNION ALL SELECT s.gid, s.step, s.k, CASE WHEN f.x_left + 7 <= s.hi THEN s.lo ELSE f.x_left END, f.x_left + 7 <= s.hi FROM fold AS f JOIN span AS s ON s.gid = f.gid AND s.k = f.k + 1)"""


@plan(f"{_STICK} SELECT gid, step, x_left, moved FROM fold")
def sticky_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.sticky_windows(fx.groups(spark, sf_dir), C)


@plan(f"{_STICK} SELECT gid, step FROM fold WHERE moved")
def reanchor_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.reanchor_steps(fx.groups(spark, sf_dir), C)




@plan("""SELECT st.step, src, dst FROM (SELECT DISTINCT step FROM gv) AS st, (SELECT src, dst FROM ring UNION SELECT dst, src FROM ring
UNION SELECT id, CAST(id + 10 AS INT) FROM node WHERE x < 9 UNION SELECT CAST(id + 10 AS INT), id FROM node WHERE x < 9)""")
def potential_grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.potential_grid(fx.groups(spark, sf_dir), spark, C)


@plan(f", {_BOXES} SELECT a AS start_step, b AS end_step, gid, xmin - 0.5::DOUBLE AS xmin, xmax + 0.5::DOUBLE AS xmax, ymin - 0.5::DOUBLE AS ymin, ymax + 0.5::DOUBLE AS ymax FROM boxes")
def inflated_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups' boxes, drawn larger."""
    return grid.inflated(_boxes(spark, sf_dir), 0.5)
