"""Populations on the regions of the events table: chance fill over time, crossover with repair, random peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylattice.operators import fill, links, paths, search, sequences
from skylattice.plans import fixtures as fx
from skylattice.plans import link_plans
from skylattice.plans.registry import plan
from skylattice.sources.shared import written

C, T, SETUP, SIZE = fx.C, fx.STEPS, 2, 12

_HASH = "((CAST(ind_id AS BIGINT) * 7919 + CAST(src AS BIGINT) * 104729 + CAST(t AS BIGINT) * 1299709) * 48271) % 2147483647"
# One round a place and individual: the keys 24 * node + t of busy right and left ports are in two lists.
_FILL = """{before}, att AS (SELECT CAST(i AS INT) AS ind_id, id AS src, CAST(s AS INT) AS t FROM range({size}) AS p(i), node, range(22) AS q(s) WHERE x < 9),
hatt AS (SELECT *, {hash} AS h FROM att),
natt AS (SELECT *, row_number() OVER (PARTITION BY ind_id ORDER BY src // 10, h, src, t) AS n,
  list_filter([src // 10 * 10 + 10 + (src + 9) % 10, src + 10, src // 10 * 10 + 10 + (src + 1) % 10, src + 20], lambda d: d < 100) AS cands FROM hatt),
go AS (SELECT CAST(i AS INT) AS ind_id, CAST(0 AS BIGINT) AS n, [k FOR k IN (SELECT coalesce(list(src * 24 + s), []) FROM base, LATERAL (SELECT unnest(generate_series(t_setup, t_end)) AS s))] AS rp,
         [k FOR k IN (SELECT coalesce(list(dst * 24 + s), []) FROM base, LATERAL (SELECT unnest(generate_series(t_setup, t_end)) AS s))] AS lp, CAST(NULL AS INT) AS src, CAST(NULL AS INT) AS dst, CAST(NULL AS INT) AS t FROM range({size}) AS p(i)),
run AS (SELECT * FROM go
  UNION ALL SELECT ind_id, n, CASE WHEN dst IS NULL THEN rp ELSE list_concat(rp, [24 * src + t, 24 * src + t + 1, 24 * src + t + 2]) END, CASE WHEN dst IS NULL THEN lp ELSE list_concat(lp, [24 * dst + t, 24 * dst + t + 1, 24 * dst + t + 2]) END, src, dst, t
  FROM (SELECT ind_id, n, rp, lp, src, t, CASE WHEN list_has_any(rp, [24 * src + t, 24 * src + t + 1, 24 * src + t + 2]) OR len(open_) = 0 THEN NULL ELSE open_[1 + (h // 1000) % len(open_)] END AS dst
        FROM (SELECT a.ind_id, a.n, r.rp, r.lp, a.src, a.t, a.h, list_filter(a.cands, lambda d: NOT list_has_any(r.lp, [24 * d + a.t, 24 * d + a.t + 1, 24 * d + a.t + 2])) AS open_ FROM run AS r JOIN natt AS a ON a.ind_id = r.ind_id AND a.n = r.n + 1))),
seq AS (SELECT ind_id, src, dst, t AS t_setup, CAST(t + 2 AS INT) AS t_work, CAST(t + 2 AS INT) AS t_end FROM run WHERE dst IS NOT NULL
  UNION ALL SELECT CAST(i AS INT), src, dst, t_setup, t_work, t_end FROM base, range({size}) AS p(i))"""
_BASE = f"""{link_plans._SKELETON}, base AS (SELECT src, dst, t_setup, t_work, t_end FROM skel AS s WHERE NOT EXISTS (SELECT 1 FROM skel AS o WHERE o.src = s.src AND o.gid < s.gid AND o.t_setup <= s.t_end AND s.t_setup <= o.t_end))"""
_REGIONS = _FILL.format(before=_BASE, size=SIZE, hash=_HASH)


def _individuals(spark: SparkSession, size: int = SIZE) -> DataFrame:
    return spark.range(size).select(F.col("id").cast("int").alias("ind_id"))


def _on_regions(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    """The regions' links in every individual; where two regions want one link at a time, that of the smaller one stays."""
    skeleton = links.region_skeleton(fx.groups(spark, sf_dir).where("gid IN (0, 4)"), C, SETUP)
    earlier = skeleton.alias("o")
    meets = (F.col("o.src") == F.col("s.src")) & (F.col("o.gid") < F.col("s.gid")) & (F.col("o.t_setup") <= F.col("s.t_end")) & (F.col("s.t_setup") <= F.col("o.t_end"))
    own = skeleton.alias("s").join(earlier, meets, "left_anti")
    return own.select(F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("ind_id"), *sequences.LINK[1:])


def filled(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    return fill.filled_over_time(_on_regions(spark, sf_dir, size), _individuals(spark, size), C, SETUP, T)


@plan(f"{_REGIONS} SELECT ind_id, src, dst, t_setup, t_work, t_end FROM seq")
def fill_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(spark, sf_dir)


_GROWN = f"""{_REGIONS}, grown AS (SELECT ind_id, src, dst, t_setup, t_work, CAST(greatest(t_end, least(coalesce(lead(t_setup) OVER (PARTITION BY ind_id, src ORDER BY t_setup), 24), coalesce(lead(t_setup) OVER (PARTITION BY ind_id, dst ORDER BY t_setup), 24)) - 1) AS INT) AS t_end FROM seq)"""


def grown(spark: SparkSession, sf_dir: str, size: int = SIZE) -> DataFrame:
    """Filled individuals whose links work on for as long as both ports are free."""
    return links.extended(filled(spark, sf_dir, size), T, ("ind_id",))


@plan(f"{_GROWN} SELECT ind_id, src, dst, t_setup, t_work, t_end FROM grown")
def grown_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grown(spark, sf_dir)


_CROSSED = f"""{_GROWN}, mates AS (SELECT CAST(i AS INT) AS child, CAST(i AS INT) AS a, CAST((i * 5 + 1) % {SIZE} AS INT) AS b, CAST((4 * i) % 9 AS INT) AS point FROM range({SIZE}) AS r(i)),
fa AS (SELECT child AS ind_id, src, dst, t_setup, t_work, t_end, CASE WHEN dst // 10 > point THEN 'rewritten' ELSE 'none' END AS repair FROM mates JOIN grown ON ind_id = a WHERE src // 10 <= point),
fb AS (SELECT child AS ind_id, src, dst, t_setup, t_work, t_end FROM mates JOIN grown ON ind_id = b WHERE src // 10 > point),
hit AS (SELECT fb.*, (SELECT min(greatest(fa.t_setup, fb.t_setup)) FROM fa WHERE fa.ind_id = fb.ind_id AND fa.dst = fb.dst AND fa.t_setup <= fb.t_end AND fb.t_setup <= fa.t_end) AS since FROM fb),
kept AS (SELECT * FROM fa UNION ALL SELECT ind_id, src, dst, t_setup, t_work, t_end, 'none' FROM hit WHERE since IS NULL
  UNION ALL SELECT ind_id, src, dst, t_setup, t_work, CAST(since - 1 AS INT), 'cut' FROM hit WHERE since > t_work),
home AS (SELECT h.ind_id, h.src, CAST((x + dx) * 10 + (y + dy + 10) % 10 AS INT) AS dst, since AS t_setup, t_end, k FROM hit AS h JOIN node ON id = src, (VALUES (0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 2, 0)) AS v(k, dx, dy)
  WHERE t_end - since >= 2 AND x + dx < 10 AND (x + dx) * 10 + (y + dy + 10) % 10 <> h.dst),
want AS (SELECT ind_id, src, dst, t_setup, t_end FROM home WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.ind_id = home.ind_id AND kept.dst = home.dst AND kept.t_setup <= home.t_end AND home.t_setup <= kept.t_end)
  QUALIFY row_number() OVER (PARTITION BY ind_id, src, t_setup ORDER BY k) = 1)"""


@plan(f"""{_CROSSED} SELECT * FROM kept UNION ALL SELECT ind_id, src, dst, t_setup, CAST(t_setup + 2 AS INT), t_end, 're-homed' FROM want AS w
WHERE NOT EXISTS (SELECT 1 FROM want AS o WHERE o.ind_id = w.ind_id AND o.dst = w.dst AND o.src < w.src AND o.t_setup <= w.t_end AND w.t_setup <= o.t_end)""")
def crossover_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.crossover_repaired(_mates(spark), written(grown(spark, sf_dir)), spark, C, SETUP)


def _mates(spark: SparkSession) -> DataFrame:
    return spark.range(SIZE).selectExpr("CAST(id AS INT) AS child", "CAST(id AS INT) AS a", f"CAST((id * 5 + 1) % {SIZE} AS INT) AS b", "CAST(4 * id % 9 AS INT) AS point")


@plan(f"""{_GROWN}, mem2 AS (SELECT step, gid, sat_id FROM gv WHERE gid IN (0, 4)),
inner_ AS (SELECT a.step, a.sat_id AS s, a.sat_id + 10 AS d FROM mem2 AS a JOIN mem2 AS b ON b.step = a.step AND b.gid = a.gid AND b.sat_id = a.sat_id + 10),
safe AS (SELECT step, s AS id FROM inner_ UNION SELECT step, d FROM inner_),
gap AS (SELECT ind_id, src, CAST(t_end + 1 AS INT) AS t, CAST(coalesce(lead(t_setup) OVER (PARTITION BY ind_id, src ORDER BY t_setup), 24) - 1 AS INT) AS until FROM grown),
ok AS (SELECT gap.*, k, CAST((x + dx) * 10 + (y + dy + 10) % 10 AS INT) AS dst FROM gap JOIN node ON id = src, (VALUES (0, 1, -1), (1, 1, 0), (2, 1, 1), (3, 2, 0)) AS v(k, dx, dy)
  WHERE until - t >= 2 AND x + dx < 10 AND (t + 2, CAST((x + dx) * 10 + (y + dy + 10) % 10 AS INT)) NOT IN (SELECT (step, id) FROM safe)),
drawn AS (SELECT *, row_number() OVER (PARTITION BY ind_id, src, t ORDER BY k) - 1 AS nth, count(*) OVER (PARTITION BY ind_id, src, t) AS n FROM ok)
SELECT ind_id, src, t, until, dst FROM drawn WHERE nth = ({_HASH} // 1000) % n""")
def establish_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random peer for every gap behind a link that has room for one."""
    whole = grown(spark, sf_dir)
    ahead = F.lead("t_setup").over(Window.partitionBy("ind_id", "src").orderBy("t_setup"))
    gaps = whole.select("ind_id", "src", (F.col("t_end") + 1).cast("int").alias("t"), (F.coalesce(ahead, F.lit(T)) - 1).cast("int").alias("until"))
    safe = sequences.region_ends(fx.groups(spark, sf_dir).where("gid IN (0, 4)"), C)
    return sequences.random_peers(gaps, safe, spark, C, SETUP)


#: The surveyed size, and generations of the registered search.
POPULATION, GENERATIONS = 200, 1


def searched(spark: SparkSession, sf_dir: str, size: int, generations: int) -> tuple[DataFrame, DataFrame, list[int]]:
    members = written(fx.groups(spark, sf_dir).where("gid IN (0, 4)"))
    pairs = paths.region_pairs(members, 0, 4).where("step >= 2")
    return search.search_sequences(spark, grown(spark, sf_dir, size), size, pairs, fx.importance(spark, sf_dir), sequences.region_ends(members, C), C, SETUP, T, generations)


@plan()
def search_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred individuals on the regions of the events, for one generation; ``searched`` goes on for as many as are asked for."""
    return searched(spark, sf_dir, POPULATION, GENERATIONS)[0]
