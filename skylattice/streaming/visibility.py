"""Visibility and links as streams. The batch operators have no stream of their own; these are the same rows, kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skylattice.functions.grid import SMALL, Constellation

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as they appear in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def group_visibility(stream: DataFrame, stations: DataFrame, c: Constellation = SMALL, late: str = "2 hours") -> DataFrame:
    """``ts_hour, step, gid, sat_id`` once each; state older than ``late`` is dropped."""
    station, hour = F.col("event_id") % 20, F.hour("ts")
    x = (F.floor(station / 2) + F.col("user_id") % 2) % c.planes
    y = (station * 3 + hour + F.col("user_id") % 3) % c.slots
    seen = stream.withColumn("ts_hour", F.date_trunc("hour", F.col("ts").cast("timestamp"))).withWatermark("ts_hour", late)
    rows = seen.select("ts_hour", hour.cast("int").alias("step"), station.cast("int").alias("station_id"), (x * c.slots + y).cast("int").alias("sat_id"))
    return rows.join(F.broadcast(stations), "station_id").select("ts_hour", "step", "gid", "sat_id").dropDuplicates(["ts_hour", "step", "gid", "sat_id"])


def coverage(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """How many events each hour has; emitted when the hour can no longer change."""
    rows = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users")).select("window.start", "n", "users")


def link_changes(links: DataFrame) -> DataFrame:
    """``src, step, old, new`` whenever a node's right link differs from the one before; one state a node.

    ``links``: a stream of ``step, src, dst`` (-1 for none) whose steps of a node arrive in order of micro-batches.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for step, dst in pd.concat(frames).sort_values("step")[["step", "dst"]].itertuples(index=False):
            if last is not None and dst != last:
                rows.append((key[0], int(step), int(last), int(dst)))
            last = int(dst)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["src", "step", "old", "new"])

    return links.groupBy("src").applyInPandasWithState(update, "src int, step int, old int, new int", "last int", "append", GroupStateTimeout.NoTimeout)
