from pyspark.sql import functions as F

from skylattice.operators.visibility import by_group
from skylattice.sources.tables import STATION_GROUPS, station_dimension, visibility_from_events
from skylattice.streaming import visibility

SF = "/root/testdata/sf0.001"


def run(spark, stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_group_stream_has_the_batch_rows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stations = station_dimension(spark, STATION_GROUPS, "gid")
    got = run(spark, visibility.group_visibility(visibility.events(spark, str(tmp_path / "in")), stations), "groups")
    want = by_group(visibility_from_events(events), stations, "gid", 0, 24)
    assert sorted(map(tuple, got.select("step", "gid", "sat_id").distinct().collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == got.distinct().count()


def test_coverage_is_final_when_emitted(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run(spark, visibility.coverage(visibility.events(spark, str(tmp_path / "in"))), "coverage")
    want = {r[0]: r[1] for r in events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp"))).count().collect()}
    rows = {r.start: r.n for r in got.collect()}
    assert rows and all(want[k] == n for k, n in rows.items())


def test_link_changes_keep_one_state_a_node(spark, tmp_path):
    rows = [(0, 1, 5), (1, 1, 5), (2, 1, 6), (3, 1, -1), (0, 2, 9), (3, 2, 9)]
    for k in (0, 1):
        part = [r for r in rows if (r[0] >= 2) == k]
        spark.createDataFrame(part, "step int, src int, dst int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("step int, src int, dst int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, visibility.link_changes(stream), "changes")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 5, 6), (1, 3, 6, -1)]
