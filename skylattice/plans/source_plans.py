"""Queries that write XML and read it again, with the SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.grid import node_id, plane, slot
from skylattice.plans import fixtures as fx
from skylattice.plans.registry import plan
from skylattice.sources import xml
from skylattice.sources.shared import shared_dir
from skylattice.sources.tables import parquet, visibility_from_events

C = fx.C


def _path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/xml-{uuid.uuid4().hex}"


@plan("SELECT step, station_id, sat_id FROM vis")
def visibility_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    xml.write_visibility(visibility_from_events(parquet(spark, sf_dir, "events"), C), path)
    return xml.read_visibility(spark, path)


@plan("SELECT step, src, dst FROM link")
def edge_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark)
    xml.write_edges(fx.links(spark, sf_dir), path)
    return xml.read_edges(spark, path)


_NODES = """SELECT CAST(a.src // 10 AS INT) AS x, CAST(a.src % 10 AS INT) AS y, a.step AS t, {middle}, a.dst AS right_id, b.src AS left_id, a.src / 8 AS importance
FROM link AS a LEFT JOIN link AS b ON b.step = a.step AND b.dst = a.src"""


def _node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = fx.links(spark, sf_dir)
    left = right.select("step", F.col("src").alias("left_src"), F.col("dst").alias("src"))
    rows = right.join(left, ["step", "src"], "left")

    def place(c: str) -> F.Column:
        return F.when(F.col(c).isNotNull(), F.struct(plane(c, C).alias("x"), slot(c, C).alias("y"), F.col("step").alias("t")))

    return rows.select(
        plane("src", C).alias("x"), slot("src", C).alias("y"), F.col("step").alias("t"), (F.col("src") % 2 == 0).alias("asc"), place("dst").alias("right"), place("left_src").alias("left"), F.lit(2).alias("state"),
        (F.col("src") % 5 - 1).alias("region_id"), (F.col("src") % 4 - 1).alias("left_state"), (F.col("src") % 3).alias("right_state"), (F.col("src") / 8).alias("importance"),
    )


def _reread(spark: SparkSession, nodes: DataFrame, version: int) -> DataFrame:
    path = _path(spark)
    xml.write_nodes(nodes, path, version)
    return xml.read_nodes(spark, path, version)


def _flat(nodes: DataFrame, *middle: str | F.Column) -> DataFrame:
    return nodes.select("x", "y", "t", *middle, node_id("right.x", "right.y", C).alias("right_id"), node_id("left.x", "left.y", C).alias("left_id"), "importance")


@plan(_NODES.format(middle="a.src % 2 = 0 AS asc_flag, 2 AS state"))
def node_state_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_reread(spark, _node_table(spark, sf_dir), 1), F.col("asc").alias("asc_flag"), "state")


@plan(_NODES.format(middle="a.src % 2 = 0 AS asc_flag, 2 AS state"))
def node_v2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_reread(spark, _node_table(spark, sf_dir), 2), F.col("asc").alias("asc_flag"), "state")


@plan(_NODES.format(middle="CAST(a.src % 5 - 1 AS INT) AS region_id, CAST(a.src % 4 - 1 AS INT) AS left_state, CAST(a.src % 3 AS INT) AS right_state"))
def node_v3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_reread(spark, _node_table(spark, sf_dir), 3), "region_id", "left_state", "right_state")


@plan("""SELECT CAST(a.src // 10 AS INT) AS x, CAST(a.src % 10 AS INT) AS y, a.step AS t, a.src % 2 = 0 AS asc_flag, 2 AS state, CASE WHEN EXISTS (SELECT 1 FROM link AS r WHERE r.step = a.step AND r.src = a.dst) THEN a.dst END AS right_id,
CASE WHEN EXISTS (SELECT 1 FROM link AS l WHERE l.step = a.step AND l.src = b.src) THEN b.src END AS left_id, a.src / 8 AS importance FROM link AS a LEFT JOIN link AS b ON b.step = a.step AND b.dst = a.src""")
def managed_chromosome_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(xml.with_known_neighbors(_reread(spark, _node_table(spark, sf_dir), 1)), F.col("asc").alias("asc_flag"), "state")
