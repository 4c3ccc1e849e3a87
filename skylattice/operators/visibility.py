"""Which group of stations sees which satellites, group envelopes, and the frame that moves with a region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylattice.functions.grid import Constellation, node_id, plane, slot, to_raw_frame, to_region_frame
from skylattice.sources.shared import written


def by_group(visibility: DataFrame, stations: DataFrame, name: str, start: int, end: int, inclusive: bool = False) -> DataFrame:
    """Distinct ``step, <name>, sat_id`` of the steps in [start, end), or [start, end] if ``inclusive``.

    ``stations`` is the fixed station dimension; stations outside it are dropped.
    """
    last = F.col("step") <= end if inclusive else F.col("step") < end
    return grouped(visibility.where((F.col("step") >= start) & last), stations, name)


def grouped(visibility: DataFrame, stations: DataFrame, name: str) -> DataFrame:
    """Distinct ``step, <name>, sat_id`` of all steps."""
    return visibility.join(F.broadcast(stations), "station_id").select("step", name, "sat_id").distinct()


def coverage(groups: DataFrame) -> DataFrame:
    """How many satellites any group sees at each step."""
    return groups.groupBy("step").agg(F.countDistinct("sat_id").alias("n_sats"))


def owners(groups: DataFrame) -> DataFrame:
    """The smallest group id that sees each satellite at each step."""
    return groups.groupBy("step", "sat_id").agg(F.min("gid").alias("gid"))


def group_offsets(groups: DataFrame, c: Constellation, reference: int = 0, seam_cut: int = 5) -> DataFrame:
    """``step, offset``: the top slot of the reference group; below the seam if the group touches slot 0.

    Steps at which the reference group sees nothing have no row.
    """
    y = slot("sat_id", c)
    rows = groups.where(F.col("gid") == reference)
    top = F.when(F.min(y) != 0, F.max(y)).otherwise(F.max(F.when(y <= seam_cut, y)))
    return rows.groupBy("step").agg(top.cast("int").alias("offset"))


def to_frame(rows: DataFrame, offsets: DataFrame, c: Constellation, *nodes: str, raw: bool = False) -> DataFrame:
    """Moves node columns into the region frame, or back into the raw one; steps without an offset are dropped."""
    shift = to_raw_frame if raw else to_region_frame
    moved = rows.join(offsets, "step")
    return moved.withColumns({n: node_id(plane(n, c), shift(slot(n, c), "offset", c), c) for n in nodes}).drop("offset")


def _envelope(c: Constellation) -> list[Column]:
    """Nullable bounds of a group, in two parts if it touches both end planes."""
    x, y = plane("sat_id", c), slot("sat_id", c)
    split = c.planes // 2

    def bounds(side: str, inside: Column) -> list[Column]:
        return [f(F.when(inside, v)).alias(f"{side}_{n}") for n, f, v in (("xmin", F.min, x), ("xmax", F.max, x), ("ymin", F.min, y), ("ymax", F.max, y))]

    return [F.min(x).alias("lo"), F.max(x).alias("hi"), *bounds("all", F.lit(True)), *bounds("left", x < split), *bounds("right", x >= split)]


def _split(df: DataFrame, c: Constellation, keys: list[str]) -> DataFrame:
    seam = (F.col("lo") == 0) & (F.col("hi") == c.planes - 1)
    names = ("xmin", "xmax", "ymin", "ymax")
    left = [F.when(seam, F.col(f"left_{n}")).otherwise(F.col(f"all_{n}")).alias(f"left_{n}") for n in names]
    right = [F.when(seam, F.col(f"right_{n}")).alias(f"right_{n}") for n in names]
    return df.select(*keys, *left, *right)


def interval_envelope(groups: DataFrame, c: Constellation, start: int, end: int) -> DataFrame:
    """One envelope for each group over the steps [start, end], both inclusive."""
    rows = groups.where(F.col("step").between(start, end))
    return _split(rows.groupBy("gid").agg(*_envelope(c)), c, ["gid"])


def envelope_trace(groups: DataFrame, c: Constellation, gid: int, start: int, end: int) -> DataFrame:
    """The envelope of one group at every step of [start, end]; nulls where it sees nothing."""
    steps = groups.sparkSession.range(start, end + 1).select(F.col("id").cast("int").alias("step"))
    rows = groups.where((F.col("gid") == gid) & F.col("step").between(start, end))
    return steps.join(_split(rows.groupBy("step").agg(*_envelope(c)), c, ["step"]), "step", "left")


def envelope_by_interval(groups: DataFrame, intervals: DataFrame, c: Constellation) -> DataFrame:
    """Single boxes for each interval (``start_step, end_step``, a small dimension) and group; -1 where a group is empty."""
    x, y = plane("sat_id", c), slot("sat_id", c)
    steps = intervals.select("start_step", "end_step", F.explode(F.sequence("start_step", "end_step")).alias("step"))
    boxes = groups.join(steps, "step").groupBy("start_step", "end_step", "gid")
    found = boxes.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))
    every = intervals.crossJoin(groups.select("gid").distinct())  # intervals by the few groups
    return every.join(found, ["start_step", "end_step", "gid"], "left").na.fill(-1, ["xmin", "xmax", "ymin", "ymax"])


def at_step(steps: DataFrame, boxes: DataFrame) -> DataFrame:
    """The box of each group whose interval holds the step; of several the one that starts first."""
    spread = boxes.withColumn("step", F.explode(F.sequence("start_step", "end_step")))
    first = Window.partitionBy("step", "gid").orderBy("start_step", "end_step")
    return steps.join(spread, "step").withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")


def cyclic_width(slots: Column, c: Constellation) -> Column:
    """Slots that a set of slots spans on the ring: the ring without its widest gap."""
    ys = F.array_sort(F.array_distinct(slots))
    after = F.concat(F.slice(ys, 2, c.slots), F.transform(F.slice(ys, 1, 1), lambda y: y + c.slots))
    return (c.slots - F.array_max(F.zip_with(after, ys, lambda a, b: a - b)) + 1).cast("int")


def block_extent(groups: DataFrame, c: Constellation) -> DataFrame:
    """Length and cyclic width of a group's block; of its two edge blocks if it touches both end planes."""
    rows = groups.select("step", "gid", plane("sat_id", c).alias("x"), slot("sat_id", c).alias("y"))
    planes = rows.select("step", "gid", "x").distinct()
    by = Window.partitionBy("step", "gid")
    runs = planes.withColumn("run", F.col("x") - F.row_number().over(by.orderBy("x")))
    runs = runs.withColumns({"seam": (F.min("x").over(by) == 0) & (F.max("x").over(by) == c.planes - 1), "first": F.min("run").over(by), "last": F.max("run").over(by)})
    sided = runs.withColumn("block", F.explode(F.when(F.col("seam"), F.array_compact(F.array(F.when(F.col("run") == F.col("first"), 0), F.when(F.col("run") == F.col("last"), 1)))).otherwise(F.array(F.lit(0)))))
    joined = rows.join(sided.select("step", "gid", "x", "block"), ["step", "gid", "x"])
    return joined.groupBy("step", "gid", "block").agg((F.max("x") - F.min("x") + 1).cast("int").alias("length"), cyclic_width(F.collect_set("y"), c).alias("width"))


def _moved(left: Column, lo: Column, hi: Column, width: int) -> Column:
    """Whether a window at ``left`` (-1: nowhere yet) has to move so as to cover ``lo`` to ``hi``."""
    return (left < 0) | (left + width <= hi)


def sticky_windows(groups: DataFrame, c: Constellation, width: int = 7, block: int = 64) -> DataFrame:
    """Left edge of a window that stays where it is while it still covers the group, by group and step.

    A scan over histories of any length. What a stretch of steps does to the window is a map from where it was (nowhere, or
    a plane) to where it is, and maps compose; so each block of ``block`` steps gives its map, each ``block`` of those
    give theirs, and so on up to one map a group. From there down every block learns where its window starts, and at
    last each step. No task has more than ``block`` rows of a group in an array.
    """
    x = plane("sat_id", c)
    spans = written(groups.groupBy("gid", "step").agg(F.min(x).cast("int").alias("lo"), F.max(x).cast("int").alias("hi")))
    last = spans.agg(F.max("step")).first()[0] or 0
    places = F.array(*(F.lit(p) for p in range(-1, c.planes)))  # where a window can be before a block

    def blocks(rows: DataFrame, at: str, *values: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(at, *values)))
        return rows.groupBy("gid", F.floor(F.col(at) / block).cast("int").alias("block")).agg(listed.alias("rows"))

    def after_step(p: Column, s: Column) -> Column:
        return F.when(_moved(p, s["lo"], s["hi"], width), s["lo"]).otherwise(p)

    def through(map_: Column, p: Column) -> Column:
        return F.element_at(map_, p + 2)

    levels = [blocks(spans, "step", "lo", "hi")]
    maps = levels[0].select("gid", "block", F.aggregate("rows", places, lambda acc, s: F.transform(acc, lambda p: after_step(p, s))).alias("map"))
    above = last // block
    while above > 0:
        levels.append(written(blocks(maps.withColumnRenamed("block", "of"), "of", "map")))
        maps = levels[-1].select("gid", "block", F.aggregate("rows", places, lambda acc, s: F.transform(acc, lambda p: through(s["map"], p))).alias("map"))
        above //= block
    starts = levels[-1].select("gid", "block", F.lit(-1).alias("start"))
    for level in levels[:0:-1]:
        none = F.struct(F.col("start").alias("p"), F.array().cast("array<struct<block:int,start:int>>").alias("out"))
        handed = F.aggregate("rows", none, lambda acc, s: F.struct(through(s["map"], acc["p"]).alias("p"), F.array_append(acc["out"], F.struct(s["of"].alias("block"), acc["p"].alias("start"))).alias("out")))
        starts = level.join(starts, ["gid", "block"]).select("gid", F.inline(handed["out"]))
    none = F.struct(F.col("start").alias("p"), F.array().cast("array<struct<step:int,x_left:int,moved:boolean>>").alias("out"))

    def walk(acc: Column, s: Column) -> Column:
        left = after_step(acc["p"], s)
        moved = (acc["p"] >= 0) & _moved(acc["p"], s["lo"], s["hi"], width)
        return F.struct(left.alias("p"), F.array_append(acc["out"], F.struct(s["step"].alias("step"), left.alias("x_left"), moved.alias("moved"))).alias("out"))

    return levels[0].join(starts, ["gid", "block"]).select("gid", F.inline(F.aggregate("rows", none, walk)["out"]))


def reanchor_steps(groups: DataFrame, c: Constellation, length: int = 7) -> DataFrame:
    """Steps at which a sticky window of ``length`` planes has to move."""
    return sticky_windows(groups, c, length).where("moved").select("gid", "step")
