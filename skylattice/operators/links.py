"""Links over time: changes, set-up and teardown, conflicts, and the life-cycle of a link as states of its node.

A link table ``step, src, dst`` has at most one right link a node and step. Left links are its columns swapped.
States: -1 free, 0 set-up starts, 1 being set up, 2 working.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from skylattice.functions.grid import Constellation, plane
from skylattice.operators.grid import nodes

def _by_node() -> WindowSpec:
    return Window.partitionBy("src").orderBy("step")


def _in_time() -> WindowSpec:
    return Window.partitionBy("src").orderBy("t")


def filled(links: DataFrame, spark: SparkSession, c: Constellation, start: int, end: int) -> DataFrame:
    """Every node at every step of [start, end) with its right link, or null."""
    every = nodes(spark, c).select(F.explode(F.sequence(F.lit(start), F.lit(end - 1))).alias("step"), F.col("id").alias("src"))
    return every.join(links, ["step", "src"], "left")


def changes(dense: DataFrame) -> DataFrame:
    """``step, node, old, new, kind``: what differs between a step and the next one, on a dense table.

    A node whose link is taken over by another node at the next step is reported as displaced too.
    """
    moved = dense.withColumns({"new": F.lead("dst").over(_by_node()), "next": F.lead("step").over(_by_node())}).where("next IS NOT NULL AND NOT (dst <=> new)")
    kind = F.when(F.col("dst").isNull(), "appears").when(F.col("new").isNull(), "ends").otherwise("changes")
    own = moved.select("step", F.col("src").alias("node"), F.col("dst").alias("old"), "new", kind.alias("kind"))
    taken = moved.where("new IS NOT NULL").select("step", F.col("src").alias("taker"), F.col("new").alias("dst"))
    displaced = dense.where("dst IS NOT NULL").join(taken, ["step", "dst"]).where("src <> taker")
    return own.unionByName(displaced.select("step", F.col("src").alias("node"), F.col("dst").alias("old"), F.lit(None).cast("int").alias("new"), F.lit("displaced").alias("kind")))


def pending(dense: DataFrame, setup: int, start: int) -> DataFrame:
    """Links that are being set up: the ``setup`` steps before a link appears, cut at ``start``; the later link wins."""
    coming = dense.withColumn("new", F.lead("dst").over(_by_node())).where("dst IS NULL AND new IS NOT NULL")
    spread = coming.select("src", "new", F.col("step").alias("origin"), F.explode(F.sequence(F.greatest(F.lit(start), F.col("step") - setup + 1), "step")).alias("step"))
    return spread.groupBy("step", "src").agg(F.max_by("new", "origin").alias("dst"))


def after_teardown(dense: DataFrame, c: Constellation, setup: int, start: int) -> DataFrame:
    """Links that remain if a node keeps none for ``setup`` steps before it changes; windows that would begin before ``start`` are skipped."""
    changed = dense.withColumn("old", F.lag("dst").over(_by_node())).withColumn("before", F.lag("step").over(_by_node())).where("before IS NOT NULL AND NOT (dst <=> old)")
    gone = changed.where(F.col("step") - setup >= start).select("src", F.explode(F.sequence(F.col("step") - setup, F.col("step") - 1)).alias("step")).distinct()
    across = dense.where("dst IS NOT NULL").where(plane("src", c) != plane("dst", c))
    return across.join(gone, ["step", "src"], "left_anti").select("step", "src", "dst")


def previous_link(dense: DataFrame, back: int) -> DataFrame:
    """For links that appear, the nearest link to another node at most ``back`` steps earlier."""
    last = F.last("dst", ignorenulls=True).over(_by_node().rowsBetween(-back, -1))
    at = F.last(F.when(F.col("dst").isNotNull(), F.col("step")), ignorenulls=True).over(_by_node().rowsBetween(-back, -1))
    seen = dense.withColumns({"new": F.lead("dst").over(_by_node()), "previous": last, "previous_step": at})
    return seen.where("dst IS NULL AND new IS NOT NULL AND previous IS NOT NULL AND previous <> new").select("step", "src", F.col("new").alias("dst"), "previous", "previous_step")


def build_points(dense: DataFrame) -> DataFrame:
    """Nodes that begin a link at some time."""
    return dense.withColumn("new", F.lead("dst").over(_by_node())).where("new IS NOT NULL AND NOT (dst <=> new)").select(F.col("src").alias("node")).distinct()


def resolved(dense: DataFrame, regions: DataFrame, setup: int, start: int, end: int) -> DataFrame:
    """Links without port conflicts while others are set up, all decided on the links as given.

    When a node's link changes, the old link gives way for ``setup`` steps up to the change. If the old link is inside
    a region (``id, region_id``, -1 outside) and the new one is not, the new link starts ``setup`` steps later instead.
    """
    labels = regions.where("region_id <> -1")
    own = dense.join(labels.select(F.col("id").alias("src"), F.col("region_id").alias("ra")), "src", "left").join(labels.select(F.col("id").alias("dst"), F.col("region_id").alias("rb")), "dst", "left")
    marked = own.withColumn("inside", F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)))
    moved = marked.withColumns({"new": F.lead("dst").over(_by_node()), "new_inside": F.lead("inside").over(_by_node())}).where("dst IS NOT NULL AND new IS NOT NULL AND dst <> new")
    late = F.col("inside") & ~F.col("new_inside")
    first = F.when(late, F.col("step") + 1).otherwise(F.greatest(F.lit(start), F.col("step") - setup + 1))
    last = F.when(late, F.least(F.lit(end - 1), F.col("step") + setup)).otherwise(F.col("step"))
    gone = moved.select("src", F.explode(F.sequence(first, last)).alias("step")).distinct()
    return dense.where("dst IS NOT NULL").join(gone, ["step", "src"], "left_anti").select("step", "src", "dst")


def resolved_ports(dense: DataFrame, regions: DataFrame, setup: int, start: int, end: int) -> DataFrame:
    """Links without port conflicts while others are set up, where links inside a region (``id, region_id``, -1 outside) come first.

    Three cases, all decided on the links as given. A node's link changes; or a link appears at the next step and the node had
    one at most ``setup`` steps earlier (the last counts); or a link ends because another node takes its target. Of the old
    and the new link: if both are outside or only the new one is inside a region, the node keeps no link in the ``setup``
    steps up to the present one; if only the old one is inside, the new one's node keeps none in the ``setup`` steps from the
    old link's last (in the third case from the next step) on; if both are inside nothing happens.
    """
    labels = regions.where("region_id <> -1")
    own = dense.join(labels.select(F.col("id").alias("src"), F.col("region_id").alias("ra")), "src", "left").join(labels.select(F.col("id").alias("dst"), F.col("region_id").alias("rb")), "dst", "left")
    marked = own.withColumn("inside", F.coalesce(F.col("ra") == F.col("rb"), F.lit(False)))
    before = _by_node().rowsBetween(-setup, -1)
    last = F.last(F.when(F.col("dst").isNotNull(), F.struct("step", "inside")), ignorenulls=True).over(before)
    seen = marked.withColumns({"new": F.lead("dst").over(_by_node()), "new_inside": F.lead("inside").over(_by_node()), "last": last})
    change = seen.where("dst IS NOT NULL AND new IS NOT NULL AND dst <> new").select("src", "step", F.col("src").alias("other"), F.col("step").alias("from"), F.col("inside").alias("was"), F.col("new_inside").alias("is"))
    appear = seen.where("dst IS NULL AND new IS NOT NULL AND last IS NOT NULL").select("src", "step", F.col("src").alias("other"), F.col("last.step").alias("from"), F.col("last.inside").alias("was"), F.col("new_inside").alias("is"))
    taker = marked.where("dst IS NOT NULL").select((F.col("step") - 1).alias("step"), "dst", F.col("src").alias("other"), F.col("inside").alias("is"))
    ended = seen.where("dst IS NOT NULL AND new IS NULL").join(taker, ["step", "dst"]).where("src <> other")
    ended = ended.select("src", "step", "other", (F.col("step") + 1).alias("from"), F.col("inside").alias("was"), "is")
    every = change.unionByName(appear).unionByName(ended).where("NOT (was AND is)")
    first = F.when(F.col("was"), F.col("from")).otherwise(F.greatest(F.lit(start), F.col("step") - setup + 1))
    until = F.when(F.col("was"), F.least(F.lit(end - 1), F.col("from") + setup - 1)).otherwise(F.col("step"))
    gone = every.select(F.when(F.col("was"), F.col("other")).otherwise(F.col("src")).alias("src"), F.explode(F.sequence(first, until)).alias("step")).distinct()
    return dense.where("dst IS NOT NULL").join(gone, ["step", "src"], "left_anti").select("step", "src", "dst")


def idle_gaps(dense: DataFrame, setup: int, end: int) -> DataFrame:
    """``step, src, dst, last`` of links that end at a step and could be kept to ``last``: while both nodes idle, but not in the ``setup`` steps before the next use."""
    used = dense.where("dst IS NOT NULL")
    busy = used.select("step", "src").unionByName(used.select("step", F.col("dst").alias("src"))).distinct().withColumn("busy", F.col("step"))
    ahead = Window.partitionBy("src").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    state = dense.join(busy, ["step", "src"], "left").withColumns({"next": F.lead("dst").over(_by_node()), "next_busy": F.min("busy").over(ahead)})
    ended = state.where(F.col("dst").isNotNull() & F.col("next").isNull() & (F.col("step") < end - 1))
    peers = state.select("step", F.col("src").alias("dst"), F.col("next_busy").alias("peer_busy"))
    until = F.least(F.coalesce("next_busy", F.lit(end)), F.coalesce("peer_busy", F.lit(end)))
    return ended.join(peers, ["step", "dst"]).withColumn("last", (until - setup - 1).cast("int")).where("last > step").select("step", "src", "dst", "last")


def idle_extension(dense: DataFrame, setup: int, end: int) -> DataFrame:
    """Steps by which a link may be kept after it ends (``idle_gaps``).

    A node that becomes the target of a link at the next step keeps none. All gaps are looked at in the links as given.
    """
    return idle_gaps(dense, setup, end).select(F.explode(F.sequence(F.col("step") + 1, F.col("last"))).alias("step"), "src", "dst")


def region_internal(members: DataFrame, c: Constellation) -> DataFrame:
    """``step, gid, src, dst`` of straight links whose ends are both in one region."""
    a = members.select("step", "gid", F.col("sat_id").alias("src")).where(plane("src", c) < c.planes - 1).withColumn("dst", F.col("src") + c.slots)
    return a.join(members.select("step", "gid", F.col("sat_id").alias("dst")), ["step", "gid", "dst"], "left_semi").select("step", "gid", "src", "dst")


def link_runs(internal: DataFrame) -> DataFrame:
    """Maximal runs of steps of each link: ``gid, src, dst, t_start, t_end``."""
    by = Window.partitionBy("gid", "src", "dst").orderBy("step")
    return internal.withColumn("run", F.col("step") - F.row_number().over(by)).groupBy("gid", "src", "dst", "run").agg(F.min("step").alias("t_start"), F.max("step").alias("t_end")).drop("run")


def _reach(members: DataFrame, node: str, setup: int) -> DataFrame:
    """How many steps right before each step a region member was in the region already, at most ``setup`` and not step 0."""
    by = Window.partitionBy("gid", "sat_id").orderBy("step")
    runs = members.where("step > 0").withColumn("run", F.col("step") - F.row_number().over(by))
    size = F.row_number().over(Window.partitionBy("gid", "sat_id", "run").orderBy("step")) - 1
    return runs.select("gid", F.col("sat_id").alias(node), F.col("step").alias("est"), F.least(size, F.lit(setup)).alias(f"{node}_back"))


def region_skeleton(members: DataFrame, c: Constellation, setup: int) -> DataFrame:
    """Life-cycles ``gid, src, dst, t_setup, t_work, t_end`` of region-internal links, decided from the last run back.

    Set-up may begin while an end is in the region already. A run ends before the set-up of the next kept one; it is
    kept if it then still reaches its own begin and lasts ``setup`` steps. Dropped runs cut nothing.
    """
    runs = link_runs(region_internal(members, c)).withColumn("est", F.greatest("t_start", F.lit(1)))
    runs = runs.join(_reach(members, "src", setup), ["gid", "src", "est"], "left").join(_reach(members, "dst", setup), ["gid", "dst", "est"], "left")
    begin = F.col("est") - F.greatest(F.coalesce("src_back", F.lit(0)), F.coalesce("dst_back", F.lit(0)))
    lists = runs.withColumn("b", begin).groupBy("gid", "src", "dst").agg(F.reverse(F.array_sort(F.collect_list(F.struct("t_start", "t_end", "b")))).alias("runs"))

    def decide(acc: Column, r: Column) -> Column:
        end = F.least(r["t_end"], acc["next"] - 1)
        keep = (end >= r["t_start"]) & (end - r["b"] >= setup)
        row = F.struct(r["b"].alias("t_setup"), (r["b"] + setup).alias("t_work"), end.alias("t_end"))
        return F.struct(F.when(keep, r["b"]).otherwise(acc["next"]).alias("next"), F.when(keep, F.array_append(acc["kept"], row)).otherwise(acc["kept"]).alias("kept"))

    start = F.struct(F.lit(10**9).alias("next"), F.array().cast("array<struct<t_setup:int,t_work:int,t_end:int>>").alias("kept"))
    return lists.select("gid", "src", "dst", F.explode(F.aggregate("runs", start, decide)["kept"]).alias("k")).select("gid", "src", "dst", "k.*")


def life_cycle(intervals: DataFrame) -> DataFrame:
    """``t, src, dst, state, peer_t`` at every step of ``src, dst, t_setup, t_work, t_end``; ``peer_t`` is when the peer is named for."""
    rows = intervals.select("src", "dst", "t_setup", "t_work", F.explode(F.sequence("t_setup", "t_end")).alias("t"))
    state = F.when(F.col("t") == F.col("t_setup"), 0).when(F.col("t") < F.col("t_work"), 1).otherwise(2)
    return rows.select("t", "src", "dst", state.alias("state"), F.greatest("t", "t_work").alias("peer_t"))


def dense_states(states: DataFrame, spark: SparkSession, c: Constellation, steps: int) -> DataFrame:
    """Every node at every step with its state, -1 where it has none."""
    every = nodes(spark, c).select(F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("t"), F.col("id").alias("src"))
    return every.join(states, ["t", "src"], "left").withColumn("state", F.coalesce("state", F.lit(-1)))


def working_edges(dense: DataFrame) -> DataFrame:
    """Working links, followed from each set-up while states are 1 or 2, with the peer that the set-up named."""
    begun = F.sum(F.when(F.col("state").isin(0, -1), 1).otherwise(0)).over(_in_time())
    runs = dense.withColumn("run", begun)
    first = Window.partitionBy("src", "run").orderBy("t")
    named = runs.withColumns({"start_state": F.first("state").over(first), "peer": F.first("dst").over(first)})
    return named.where("start_state = 0 AND state = 2").select("t", "src", F.col("peer").alias("dst"))


def setup_events(states: DataFrame) -> DataFrame:
    return states.where("state = 0").select("t", "src", "dst", "peer_t")


def next_setup(dense: DataFrame) -> DataFrame:
    """The next step at which a node starts a set-up, null if it never does."""
    ahead = _in_time().rowsBetween(1, Window.unboundedFollowing)
    return dense.select("t", "src", F.min(F.when(F.col("state") == 0, F.col("t"))).over(ahead).alias("next_t"))


def free_ports(dense: DataFrame, left_used: DataFrame, setup: int, steps: int) -> DataFrame:
    """Where a node could start a link: free for the next ``setup`` steps; and could end one: no left link in the last ``setup``."""
    used = left_used.select("t", F.col("dst").alias("src"), F.lit(1).alias("left")).distinct()
    rows = dense.join(used, ["t", "src"], "left")
    ahead, behind = _in_time().rowsBetween(0, setup), _in_time().rowsBetween(-setup, 0)
    can_start = (F.max("state").over(ahead) == -1) & (F.col("t") + setup < steps)
    can_end = F.max(F.coalesce("left", F.lit(0))).over(behind) == 0
    return rows.select("t", "src", can_start.alias("can_start"), can_end.alias("can_end"))


def state_violations(dense: DataFrame) -> DataFrame:
    """``t, src, state, violation``, a row for each broken rule of a dense state table.

    Before a state may come: -1 or 2 before -1 and 0; 0 or 1 before 1; 1 or 2 before 2. After it: -1 or 0 after -1;
    1 after 0; 1 or 2 after 1; any but 1 after 2. A link is not being set up at the first step, and no set-up begins at the last.
    """
    s, b, a = F.col("state"), F.lag("state").over(_in_time()), F.lead("state").over(_in_time())
    may_come = F.when(s == 1, b.isin(0, 1)).when(s == 2, b.isin(1, 2)).otherwise(b.isin(-1, 2))
    may_follow = F.when(s == -1, a.isin(-1, 0)).when(s == 0, a == 1).when(s == 1, a.isin(1, 2)).otherwise(a != 1)
    broken = F.array_compact(
        F.array(
            F.when(~may_come, "wrong before"),
            F.when(~may_follow, "wrong after"),
            F.when((s == 1) & b.isNull(), "being set up at the first step"),
            F.when((s == 0) & a.isNull(), "begins at the last step"),
        )
    )
    return dense.withColumn("broken", broken).select("t", "src", "state", F.explode("broken").alias("violation"))


def left_violations(states: DataFrame, left_view: DataFrame, setup: int) -> DataFrame:
    """``t, node, left_src, state, violation``: entries of the left view (``t, node, left_src``) that the left node's state belies.

    ``states`` are rows ``t, src, dst, state, peer_t``. Where the left node begins a set-up it must name this node at ``t + setup``;
    during the set-up this node and a step less than ``setup`` ahead; while it works this node at ``t``. A left node
    without a state must have a right neighbour at least, so it is always wrong here.
    """
    peers = states.select("t", F.col("src").alias("left_src"), "dst", "state", "peer_t")
    seen = left_view.join(peers, ["t", "left_src"], "left").withColumn("state", F.coalesce("state", F.lit(-1)))
    other, s = F.col("dst") != F.col("node"), F.col("state")
    broken = F.array_compact(
        F.array(
            F.when(s == -1, "left node has no link"),
            F.when((s == 0) & (other | (F.col("peer_t") != F.col("t") + setup)), "set-up names another place"),
            F.when((s == 1) & other, "set-up is with another node"),
            F.when((s == 1) & (F.col("peer_t") - F.col("t") >= setup), "set-up ends too late"),
            F.when((s == 2) & (other | (F.col("peer_t") != F.col("t"))), "link is with another place"),
        )
    )
    return seen.withColumn("broken", broken).select("t", "node", "left_src", "state", F.explode("broken").alias("violation"))


def left_working(states: DataFrame, left_view: DataFrame) -> DataFrame:
    """Working links as the left view tells them: the left neighbour's state is 2."""
    working = states.where("state = 2").select("t", F.col("src").alias("left_src"))
    return left_view.join(working, ["t", "left_src"], "left_semi").select("t", F.col("left_src").alias("src"), F.col("node").alias("dst"))


def region_violations(members: DataFrame, states: DataFrame, c: Constellation, since: int = 2) -> DataFrame:
    """Adjacent members of a region that no working link joins at a step from ``since`` on."""
    linked = states.where("state = 2").select(F.col("t").alias("step"), "src", "dst")
    return region_internal(members, c).where(F.col("step") >= since).join(linked, ["step", "src", "dst"], "left_anti")


def difference(right: DataFrame, left: DataFrame) -> DataFrame:
    """Rows that only one of two edge tables has, and which."""
    return right.exceptAll(left).distinct().withColumn("side", F.lit("right")).unionByName(left.exceptAll(right).distinct().withColumn("side", F.lit("left")))


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables; where both have a key, those of the second."""
    return second.unionByName(first.join(second.select(*keys), keys, "left_anti"))


def targets_freed(dense: DataFrame, kept: DataFrame, setup: int, start: int) -> DataFrame:
    """``kept`` without links to a node that another node's new link takes over: none in the ``setup`` steps before it."""
    coming = dense.withColumn("new", F.lead("dst").over(_by_node())).where("new IS NOT NULL AND NOT (dst <=> new)")
    spread = coming.select(F.col("src").alias("taker"), F.col("new").alias("dst"), F.explode(F.sequence(F.greatest(F.lit(start), F.col("step") - setup + 1), "step")).alias("step"))
    lost = kept.join(spread, ["step", "dst"]).where("src <> taker").select("step", "src").distinct()
    return kept.join(lost, ["step", "src"], "left_anti")


def extended(intervals: DataFrame, steps: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every link works on until its node's next set-up, or to the last step; its target's next use ends it too. ``by`` names what keeps individuals apart."""
    ahead = F.lead("t_setup").over(Window.partitionBy(*by, "src").orderBy("t_setup"))
    at_target = F.lead("t_setup").over(Window.partitionBy(*by, "dst").orderBy("t_setup"))
    until = F.least(F.coalesce(ahead, F.lit(steps)), F.coalesce(at_target, F.lit(steps))) - 1
    return intervals.select(*by, "src", "dst", "t_setup", "t_work", F.greatest("t_end", until).cast("int").alias("t_end"))


def cleared(intervals: DataFrame, picks: DataFrame) -> DataFrame:
    """Without the life-cycles that run through a picked place ``src, t``."""
    hit = intervals.join(picks, "src").where(F.col("t").between(F.col("t_setup"), F.col("t_end"))).select("src", "t_setup").distinct()
    return intervals.join(hit, ["src", "t_setup"], "left_anti")


def established(intervals: DataFrame, wishes: DataFrame, setup: int, steps: int) -> DataFrame:
    """Adds the wished links ``src, dst, t`` from their step on, for as long as the ports of both ends are free.

    A wish needs ``setup`` steps and one to work; of wishes of one source, or of one target, the smallest comes first
    and the others are dropped.
    """
    taken = intervals.select("src", "dst", "t_setup", "t_end")

    def room(side: str) -> DataFrame:
        near = wishes.alias("w").join(taken.alias("i"), (F.col(f"w.{side}") == F.col(f"i.{side}")) & (F.col("w.t") <= F.col("i.t_end")), "left")
        return near.groupBy(*(F.col(f"w.{c}").alias(c) for c in ("src", "dst", "t"))).agg(F.coalesce(F.min("i.t_setup"), F.lit(steps)).alias(f"until_{side}"))

    free = room("src").join(room("dst"), ["src", "dst", "t"]).withColumn("t_end", F.least("until_src", "until_dst") - 1).where(F.col("t_end") - F.col("t") >= setup)
    one = free.withColumn("of_src", F.row_number().over(Window.partitionBy("src").orderBy("t", "dst"))).where("of_src = 1")
    one = one.withColumn("of_dst", F.row_number().over(Window.partitionBy("dst").orderBy("t", "src"))).where("of_dst = 1")
    return intervals.unionByName(one.select("src", "dst", F.col("t").alias("t_setup"), (F.col("t") + setup).cast("int").alias("t_work"), F.col("t_end").cast("int")))
