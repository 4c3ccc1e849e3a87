"""Row generators on the grid: nodes, links of rings, rows and motifs, rectangles, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.grid import Constellation, is_curved, node_id, plane, same_plane, slot


def nodes(spark: SparkSession, c: Constellation) -> DataFrame:
    """``id, x, y`` of every satellite."""
    ids = spark.range(c.size).select(F.col("id").cast("int").alias("id"))
    return ids.select("id", plane("id", c).alias("x"), slot("id", c).alias("y"))


def grid_nodes(spark: SparkSession, c: Constellation, start: int, end: int) -> DataFrame:
    """Every node at every step of [start, end), free and without importance."""
    return nodes(spark, c).select("x", "y", F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("t"), F.lit(-1).alias("state"), F.lit(-1.0).alias("importance"))


def ring_edges(spark: SparkSession, c: Constellation) -> DataFrame:
    """Links to the neighbours above and below in the own plane."""
    return _to_ring(nodes(spark, c), [], c)


def ring_edges_of(nodes: DataFrame, keep: list[str], c: Constellation) -> DataFrame:
    """Ring links of the nodes ``id, x, y``, with the columns ``keep``."""
    return _to_ring(nodes, keep, c)


def _to_ring(rows: DataFrame, keep: list[str], c: Constellation) -> DataFrame:
    up, down = F.pmod(F.col("y") + 1, F.lit(c.slots)), F.pmod(F.col("y") - 1, F.lit(c.slots))
    return rows.select(*keep, F.col("id").alias("src"), F.explode(F.array(node_id("x", up, c), node_id("x", down, c))).alias("dst"))


def ring_edges_at(steps: DataFrame, c: Constellation) -> DataFrame:
    """``ring_edges`` of every row of ``steps``, with its columns."""
    ids = steps.select("*", F.explode(F.sequence(F.lit(0), F.lit(c.size - 1))).alias("id"))
    return _to_ring(ids.withColumns({"x": plane("id", c), "y": slot("id", c)}), steps.columns, c)


def grid_edges(spark: SparkSession, c: Constellation) -> DataFrame:
    """Ring links and links to the next plane, of all planes but the last."""
    return grid_edges_of(nodes(spark, c), [], c)


def grid_edges_of(rows: DataFrame, keep: list[str], c: Constellation) -> DataFrame:
    """``grid_edges`` of the nodes ``id, x, y``, with the columns ``keep``."""
    up, down = F.pmod(F.col("y") + 1, F.lit(c.slots)), F.pmod(F.col("y") - 1, F.lit(c.slots))
    targets = F.array(node_id(F.col("x") + 1, "y", c), node_id("x", up, c), node_id("x", down, c))
    return rows.where(F.col("x") < c.planes - 1).select(*keep, F.col("id").alias("src"), F.explode(targets).alias("dst"))


def right_links(spark: SparkSession, c: Constellation) -> DataFrame:
    """Straight links to the next plane."""
    return nodes(spark, c).where(F.col("x") < c.planes - 1).select(F.col("id").alias("src"), node_id(F.col("x") + 1, "y", c).alias("dst"))


def banded_motif(spark: SparkSession, c: Constellation, low: int = 14, high: int = 32, slant: int = 2) -> DataFrame:
    """Ring links, slanted links in the slots [low, high) as far as they stay below ``high``, straight ones elsewhere."""
    up, down = F.pmod(F.col("y") + 1, F.lit(c.slots)), F.pmod(F.col("y") - 1, F.lit(c.slots))
    band = F.col("y").between(low, high - 1)
    across = F.when(~band, node_id(F.col("x") + 1, "y", c)).when(F.col("y") + slant < high, node_id(F.col("x") + 1, F.col("y") + slant, c))
    rows = nodes(spark, c).where(F.col("x") < c.planes - 1)
    return rows.select(F.col("id").alias("src"), F.explode(F.array_compact(F.array(across, node_id("x", up, c), node_id("x", down, c)))).alias("dst"))


def rect_nodes(rects: DataFrame, c: Constellation) -> DataFrame:
    """``gid, id`` of the nodes in each rectangle ``gid, xmin, xmax, ymin, ymax``; bounds may be swapped."""
    span = lambda a, b: F.explode(F.sequence(F.least(a, b), F.greatest(a, b)))
    cells = rects.select("gid", span("xmin", "xmax").alias("x"), "ymin", "ymax").select("gid", "x", span("ymin", "ymax").alias("y"))
    return cells.select("gid", node_id("x", "y", c).alias("id")).distinct()


def motif_edges(rects: DataFrame, c: Constellation, keep: list[str] | None = None) -> DataFrame:
    """One link a node inside each rectangle: straight (``option`` 0) or one slot down (1), if the target is inside too; with the columns ``keep`` of the rectangle."""
    span = lambda a, b: F.explode(F.sequence(a, b))
    cells = rects.select("*", span("xmin", "xmax").alias("x")).select("*", span("ymin", "ymax").alias("y"))
    nx = F.col("x") + 1
    ny = F.when(F.col("option") == 0, F.col("y")).otherwise(F.pmod(F.col("y") - 1, F.lit(c.slots)))
    inside = nx.between(F.col("xmin"), F.col("xmax")) & ny.between(F.col("ymin"), F.col("ymax"))
    return cells.where(inside).select(*(keep or []), node_id("x", "y", c).alias("src"), node_id(nx, ny, c).alias("dst")).distinct()


def replicate(edges: DataFrame, start: int, end: int) -> DataFrame:
    """A static edge set at every step of [start, end)."""
    return edges.select(F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("step"), "*")


def candidates(spark: SparkSession, c: Constellation) -> DataFrame:
    """The right neighbours that a node may choose: one plane on at most one slot away, or two planes straight on."""
    x, y = F.col("x"), F.col("y")

    def to(dx: int, dy: int) -> Column:
        return F.when((x + dx < c.planes) & (y + dy).between(0, c.slots - 1), node_id(x + dx, y + dy, c))

    targets = F.array_compact(F.array(to(1, -1), to(1, 0), to(1, 1), to(2, 0)))
    return nodes(spark, c).select(F.col("id").alias("src"), F.posexplode(targets).alias("rank", "dst"))


def bidirectional(edges: DataFrame) -> DataFrame:
    """Every edge both ways, once; other columns are kept."""
    others = [x for x in edges.columns if x not in ("src", "dst")]
    return edges.unionByName(edges.select(*others, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def classified(edges: DataFrame, c: Constellation) -> DataFrame:
    """Whether each edge is within a plane, and whether it is drawn curved."""
    return edges.withColumns({"intra": same_plane("src", "dst", c), "curved": is_curved("src", "dst", c)})


def inter_plane(edges: DataFrame, c: Constellation) -> DataFrame:
    return edges.where(~same_plane("src", "dst", c))


def flow_edges(edges: DataFrame, c: Constellation, cost: int = 1, intra: int = 100, inter: int = 50, keep: list[str] | None = None) -> DataFrame:
    """Capacities: links within a plane count with both capacities, others with one; parallel edges and ``keep`` columns are kept."""
    caps = F.when(same_plane("src", "dst", c), F.array(F.lit(intra), F.lit(inter))).otherwise(F.array(F.lit(inter)))
    return edges.select(*(keep or []), "src", "dst", F.lit(cost).alias("cost"), F.explode(caps).alias("cap"))


def with_super_nodes(flow: DataFrame, sources: DataFrame, sinks: DataFrame, super_source: int = -1, super_sink: int = -2, unlimited: int = 10**9, keep: list[str] | None = None) -> DataFrame:
    """Adds a node before all sources (``node, demand``) and one behind all sinks (``node``), in each graph (``keep`` columns)."""
    keep = keep or []
    before = sources.select(*keep, F.lit(super_source).alias("src"), F.col("node").alias("dst"), F.lit(0).alias("cost"), F.col("demand").alias("cap"))
    behind = sinks.select(*keep, F.col("node").alias("src"), F.lit(super_sink).alias("dst"), F.lit(0).alias("cost"), F.lit(unlimited).alias("cap"))
    return flow.unionByName(before).unionByName(behind)


def membership(points: DataFrame, rects: DataFrame, c: Constellation) -> DataFrame:
    """The smallest rectangle id that holds each point; points outside all have no row."""
    return points.join(rect_nodes(rects, c), "id").groupBy(*points.columns).agg(F.min("gid").alias("gid"))


def labelled(points: DataFrame, rects: DataFrame, c: Constellation) -> DataFrame:
    """Each point with its region, -1 outside all of them."""
    inside = rect_nodes(rects, c).groupBy("id").agg(F.min("gid").alias("region_id"))
    return points.join(inside, "id", "left").withColumn("region_id", F.coalesce("region_id", F.lit(-1)))


def layer_coordinates(spark: SparkSession, c: Constellation, layers: int, spacing: int = 1, height: int = 10) -> DataFrame:
    """Places of all nodes in a stack of layers."""
    return layer_coordinates_of(nodes(spark, c).select(F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"), "id", "x", "y"), spacing, height)


def layer_coordinates_of(rows: DataFrame, spacing: int = 1, height: int = 10) -> DataFrame:
    """Places ``px, py, pz`` of the nodes ``layer, id, x, y``."""
    place = [(F.col("y") * spacing).alias("px"), (F.col("x") * spacing).alias("py"), (F.col("layer") * height).cast("int").alias("pz")]
    return rows.select("layer", "id", *place)


def potential_edges(members: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """Possible right links at each step: forced ones inside a region, else candidates whose target no region owns.

    ``members``: ``step, gid, sat_id``. A node with a forced link has no candidates; nor is a target of one a candidate.
    """
    a = members.select("step", "gid", F.col("sat_id").alias("src"))
    b = members.select("step", "gid", F.col("sat_id").alias("dst"))
    forced = a.where(plane("src", c) < c.planes - 1).withColumn("dst", F.col("src") + c.slots).join(b, ["step", "gid", "dst"]).select("step", "src", "dst").distinct()
    steps = members.select("step").distinct()
    free = candidates(spark, c).select("src", "dst").join(steps)  # a fixed set of candidates at every step
    free = free.join(forced.select("step", "src"), ["step", "src"], "left_anti").join(forced.select("step", "dst"), ["step", "dst"], "left_anti")
    return forced.withColumn("forced", F.lit(True)).unionByName(free.withColumn("forced", F.lit(False)))


def potential_grid(members: DataFrame, spark: SparkSession, c: Constellation) -> DataFrame:
    """Possible edges at each step on the plain grid: rings and straight links to the next plane, both ways."""
    every = bidirectional(ring_edges(spark, c).unionByName(right_links(spark, c)))
    return every.join(members.select("step").distinct()).select("step", "src", "dst")  # a fixed grid at every step


def inflated(rects: DataFrame, by: float) -> DataFrame:
    """Rectangles larger by ``by`` on each side."""
    return rects.withColumns({"xmin": F.col("xmin") - by, "ymin": F.col("ymin") - by, "xmax": F.col("xmax") + by, "ymax": F.col("ymax") + by})
