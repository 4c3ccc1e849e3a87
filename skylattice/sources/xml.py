"""XML scans and sinks: visibility, node states in three vocabularies, and edge lists, through Spark's XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VISIBILITY = "_step INT, stations STRUCT<station: ARRAY<STRUCT<_id: INT, satellite: ARRAY<STRUCT<_id: STRING>>>>>"
EDGES = "_timestamp INT, node ARRAY<STRUCT<_id: INT, neighbor: ARRAY<INT>>>"
#: Fixed attribute names of the node vocabularies.
NODE_PLACE = {1: "cordination", 2: "coordination", 3: "coordination"}


def read_visibility(spark: SparkSession, path: str) -> DataFrame:
    """``step, station_id, sat_id``; ids may be written as floats. Steps and stations without satellites have no rows."""
    rows = spark.read.format("xml").option("rowTag", "time").schema(VISIBILITY).load(path)
    stations = rows.select(F.col("_step").alias("step"), F.explode("stations.station").alias("s"))
    return stations.select("step", F.col("s._id").alias("station_id"), F.explode("s.satellite").alias("sat")).select("step", "station_id", F.expr("CAST(CAST(sat._id AS DOUBLE) AS INT)").alias("sat_id"))


def write_visibility(visibility: DataFrame, path: str) -> None:
    sats = visibility.groupBy("step", "station_id").agg(F.sort_array(F.collect_set(F.struct(F.col("sat_id").cast("double").cast("string").alias("_id")))).alias("satellite"))
    steps = sats.groupBy("step").agg(F.sort_array(F.collect_list(F.struct(F.col("station_id").alias("_id"), "satellite"))).alias("station"))
    steps.select(F.col("step").alias("_step"), F.struct("station").alias("stations")).write.mode("overwrite").format("xml").options(rootTag="root", rowTag="time").save(path)


def _place(c: Column) -> Column:
    text = F.concat(F.lit("("), F.concat_ws(", ", c["x"], c["y"], c["t"]), F.lit(")"))
    return F.when(c.isNull(), "None").otherwise(text)


def _parsed(c: Column) -> Column:
    numbers = F.regexp_extract_all(c, F.lit(r"(-?\d+)"), F.lit(1))
    return F.when(F.size(numbers) == 3, F.struct(*(F.get(numbers, k).cast("int").alias(n) for k, n in enumerate("xyt"))))


def write_nodes(nodes: DataFrame, path: str, version: int = 1) -> None:
    """Node states ``x, y, t, asc, right, left, state, importance`` (version 3: ``region_id, left_state, right_state``) as attributes."""
    own = _place(F.struct("x", "y", "t"))
    shared = [own.alias(f"_{NODE_PLACE[version]}"), _place(F.col("right")).alias("_rightneighbor"), _place(F.col("left")).alias("_leftneighbor")]
    if version == 3:
        rest = [F.col("region_id").alias("_asc_nodes_region_id"), F.col("left_state").alias("_left_state"), F.col("right_state").alias("_right_state")]
    else:
        rest = [F.when(F.col("asc"), "True").otherwise("False").alias("_asc_nodes_flag"), F.col("state").alias("_state")]
    rows = nodes.select(*shared, *rest, F.coalesce("importance", F.lit(-1.0)).alias("_importance"))
    rows.write.mode("overwrite").format("xml").options(rootTag="Nodes", rowTag="Node").save(path)


def read_nodes(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Reads what ``write_nodes`` wrote; coordinates may have brackets or none, ``None`` is null, and nothing is evaluated."""
    place = NODE_PLACE[version]
    kinds = "_asc_nodes_region_id INT, _left_state INT, _right_state INT" if version == 3 else "_asc_nodes_flag STRING, _state INT"
    schema = f"_{place} STRING, _rightneighbor STRING, _leftneighbor STRING, {kinds}, _importance DOUBLE"
    rows = spark.read.format("xml").option("rowTag", "Node").schema(schema).load(path).withColumn("p", _parsed(F.col(f"_{place}")))
    shared = ["p.x", "p.y", "p.t", _parsed(F.col("_rightneighbor")).alias("right"), _parsed(F.col("_leftneighbor")).alias("left")]
    if version == 3:
        rest = [F.col("_asc_nodes_region_id").alias("region_id"), F.col("_left_state").alias("left_state"), F.col("_right_state").alias("right_state")]
    else:
        rest = [F.col("_asc_nodes_flag").isin("1", "True", "true").alias("asc"), F.col("_state").alias("state")]
    return rows.select(*shared, *rest, F.coalesce("_importance", F.lit(-1.0)).alias("importance"))


def with_known_neighbors(nodes: DataFrame) -> DataFrame:
    """Node states whose ``right`` and ``left`` are null where the table has no node at that place."""
    places = nodes.select(F.struct("x", "y", "t").alias("place")).distinct()
    out = nodes
    for side in ("right", "left"):
        known = places.select(F.col("place").alias(side), F.lit(True).alias("known"))
        out = out.join(known, side, "left").withColumn(side, F.when(F.col("known"), F.col(side))).drop("known")
    return out.select(*nodes.columns)


def write_edges(edges: DataFrame, path: str) -> None:
    near = edges.groupBy("step", "src").agg(F.sort_array(F.collect_set("dst")).alias("neighbor"))
    steps = near.groupBy("step").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("_id"), "neighbor"))).alias("node"))
    steps.select(F.col("step").alias("_timestamp"), "node").write.mode("overwrite").format("xml").options(rootTag="graphs", rowTag="step").save(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """``step, src, dst``; nodes without neighbours have no rows."""
    rows = spark.read.format("xml").option("rowTag", "step").schema(EDGES).load(path)
    return rows.select(F.col("_timestamp").alias("step"), F.explode("node").alias("n")).select("step", F.col("n._id").alias("src"), F.explode("n.neighbor").alias("dst"))
