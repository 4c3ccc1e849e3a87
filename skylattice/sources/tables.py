"""Tables the engine starts from: station visibility, station dimensions, and the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.functions.grid import SMALL, Constellation

#: Fixed dimension: first and last station of each of the seven groups.
STATION_GROUPS = ((0, 0, 3), (1, 4, 8), (2, 9, 9), (3, 10, 10), (4, 11, 14), (5, 15, 16), (6, 17, 19))
#: Fixed dimension: first and last station of each of the six regions.
STATION_REGIONS = ((0, 0, 8), (1, 9, 9), (2, 10, 10), (3, 11, 14), (4, 15, 16), (5, 17, 18))


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def visibility_from_events(events: DataFrame, c: Constellation = SMALL) -> DataFrame:
    """``step, station_id, sat_id``: every station sees a drifting patch of two planes by three slots, by hour."""
    station, hour = F.col("event_id") % 20, F.hour("ts")
    x = (F.floor(station / 2) + F.col("user_id") % 2) % c.planes
    y = (station * 3 + hour + F.col("user_id") % 3) % c.slots
    return events.select(hour.cast("int").alias("step"), station.cast("int").alias("station_id"), (x * c.slots + y).cast("int").alias("sat_id")).distinct()


def visibility_between(events: DataFrame, c: Constellation, origin: str, seconds: int, first: str | None = None, until: str | None = None) -> DataFrame:
    """``step, station_id, sat_id`` of the instants in [first, until); a step is ``seconds`` long, counted from ``origin``.

    The patch that a station sees drifts by one slot a step. The interval is a condition on the instants themselves, so
    it reaches the scan, which leaves out row groups and partitions beyond it.
    """
    at = F.col("ts")
    if first is not None:
        events = events.where(at >= F.lit(first).cast("timestamp_ntz"))
    if until is not None:
        events = events.where(at < F.lit(until).cast("timestamp_ntz"))
    step = F.floor(F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'{origin}', ts)") / seconds).cast("int")
    seen = events.select(step.alias("step"), (F.col("event_id") % 20).cast("int").alias("station_id"), F.col("user_id"))
    x = (F.floor(F.col("station_id") / 2) + F.col("user_id") % 2) % c.planes
    y = (F.col("station_id") * 3 + F.col("step") + F.col("user_id") % 3) % c.slots
    return seen.select("step", "station_id", (x * c.slots + y).cast("int").alias("sat_id")).distinct()


def station_dimension(spark: SparkSession, ranges: tuple[tuple[int, int, int], ...], name: str) -> DataFrame:
    """``station_id`` and ``name`` from (value, first station, last station); some twenty rows."""
    rows = ", ".join(f"({v}, {a}, {b})" for v, a, b in ranges)
    return spark.sql(f"SELECT explode(sequence(a, b)) AS station_id, v AS {name} FROM VALUES {rows} AS t(v, a, b)")
