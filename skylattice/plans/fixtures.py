"""What the registered queries run on: the small constellation as seen in the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.grid import SMALL, plane, slot
from skylattice.operators import evolve, grid, visibility
from skylattice.sources.tables import STATION_GROUPS, STATION_REGIONS, parquet, station_dimension, visibility_from_events

C = SMALL
STEPS = 24
SETUP = 3
RECTS = "VALUES (0, 0, 6, 2, 6, 0), (4, 5, 9, 1, 8, 1) AS t(gid, xmin, xmax, ymin, ymax, option)"


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = visibility_from_events(parquet(spark, sf_dir, "events"), C)
    return visibility.by_group(seen, station_dimension(spark, STATION_GROUPS, "gid"), "gid", 0, STEPS)


def regions(spark: SparkSession, sf_dir: str, start: int, end: int) -> DataFrame:
    seen = visibility_from_events(parquet(spark, sf_dir, "events"), C)
    return visibility.by_group(seen, station_dimension(spark, STATION_REGIONS, "region_id"), "region_id", start, end, inclusive=True)


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.group_offsets(groups(spark, sf_dir), C)


def rects(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {RECTS}")


def motif_links(spark: SparkSession) -> DataFrame:
    """One right link a node, in the region frame."""
    return grid.motif_edges(rects(spark), C).groupBy("src").agg(F.max("dst").alias("dst"))


def links(spark: SparkSession, sf_dir: str, members: DataFrame | None = None) -> DataFrame:
    """``step, src, dst``: the motif shifted back into the raw frame, where it jumps whenever the frame moves.

    The frame follows group 0 and drifts by one slot every three steps. ``members`` are the groups where they are known.
    """
    steps = _offsets(spark, sf_dir, members).withColumn("offset", (F.col("offset") + F.floor(F.col("step") / 3)).cast("int"))
    placed = steps.select("step").crossJoin(F.broadcast(motif_links(spark)))  # a motif of a fixed size at every step
    return visibility.to_frame(placed, steps, C, "src", "dst", raw=True).select("step", "src", "dst")


def _offsets(spark: SparkSession, sf_dir: str, members: DataFrame | None) -> DataFrame:
    return visibility.group_offsets(groups(spark, sf_dir) if members is None else members, C)


def topology(spark: SparkSession, sf_dir: str, members: DataFrame | None = None) -> DataFrame:
    """All edges of each step, both ways: the motif's links and the rings."""
    across = links(spark, sf_dir, members)
    rings = _offsets(spark, sf_dir, members).select("step").crossJoin(F.broadcast(grid.ring_edges(spark, C)))  # the constellation's rings at every step
    return grid.bidirectional(across.unionByName(rings.select("step", "src", "dst")))


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, seen``: how many pairs of a step and a station see each satellite."""
    found = visibility_from_events(parquet(spark, sf_dir, "events"), C)
    return found.groupBy(F.col("sat_id").alias("src")).agg(F.count("*").alias("seen"))


def population(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Static individuals, whose choices depend on how often satellites are seen."""
    return evolve.population(spark, C, size, seen(spark, sf_dir))


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, importance`` of every satellite: the more often it is seen the greater."""
    often = seen(spark, sf_dir).select(F.col("src").alias("id"), "seen")
    return grid.nodes(spark, C).join(often, "id", "left").select("id", (F.coalesce("seen", F.lit(0)) / 40).alias("importance"))


def seen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``step, id, x, y`` of the satellites that any group sees at each step."""
    ids = groups(spark, sf_dir).select("step", F.col("sat_id").alias("id")).distinct()
    return ids.withColumns({"x": plane("id", C), "y": slot("id", C)})
