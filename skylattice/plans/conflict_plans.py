"""Queries on conflicts that are decided one after the other, with recursive SQL over whole port states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skylattice.operators import conflicts, grid, links
from skylattice.plans import fixtures as fx
from skylattice.plans.registry import plan

C, T, B = fx.C, fx.STEPS, fx.SETUP

# The links of the fixture go from a plane to the next one, so a plane has one state: a slot's right port at a step is
# r[10 * step + slot + 1], a slot of the next plane has its left port at the same place of l; -1 is free. Transition k is that of step
# k // 10 and slot k % 10.
_STATE = """, lab AS (SELECT id, x, y, CASE WHEN {regions} AND x BETWEEN 0 AND 6 AND y BETWEEN 2 AND 6 THEN 0 WHEN {regions} AND x BETWEEN 5 AND 9 AND y BETWEEN 1 AND 8 THEN 4 ELSE -1 END AS g FROM node),
port AS (SELECT n.x, list(coalesce(k.dst % 10, -1) ORDER BY s, n.y) AS r FROM node AS n CROSS JOIN range(24) AS t(s) LEFT JOIN link AS k ON k.step = s AND k.src = n.id WHERE n.x < 9 GROUP BY n.x),
port2 AS (SELECT n.x - 1 AS x, list(coalesce(k.src % 10, -1) ORDER BY s, n.y) AS l FROM node AS n CROSS JOIN range(24) AS t(s)
          LEFT JOIN (SELECT step, dst, max(src) AS src FROM link GROUP BY step, dst) AS k ON k.step = s AND k.dst = n.id WHERE n.x > 0 GROUP BY n.x),
side AS (SELECT a.x, list(a.g ORDER BY a.y) AS ga, list(b.g ORDER BY a.y) AS gb FROM lab AS a JOIN lab AS b ON b.x = a.x + 1 AND b.y = a.y GROUP BY a.x),
fold AS (SELECT port.x, 0 AS k, r, l, ga, gb FROM port JOIN port2 USING (x) JOIN side USING (x)
 UNION ALL
 SELECT x, k + 1, list_transform(r, lambda v, i: CASE WHEN (i - 1) % 10 = who AND (i - 1) // 10 BETWEEN a AND b OR list_contains(freed, i) THEN -1 ELSE v END),
   list_transform(l, lambda v, i: CASE WHEN (i - 1) // 10 BETWEEN a AND b AND r[(i - 1) // 10 * 10 + who + 1] = (i - 1) % 10 OR list_contains(held, i) THEN -1 ELSE v END), ga, gb
 FROM (SELECT *, CASE WHEN act = 'back' THEN k % 10 WHEN act = 'ahead' THEN other ELSE -1 END AS who,
         CASE WHEN act = 'back' THEN greatest(0, k // 10 - 2) WHEN act = 'ahead' THEN since END AS a, CASE WHEN act = 'back' THEN k // 10 WHEN act = 'ahead' THEN least(23, since + 2) END AS b
       FROM (SELECT *, CASE WHEN old IS NULL OR was AND is_ THEN 'none' WHEN was THEN 'ahead' ELSE 'back' END AS act
        FROM (SELECT *, CASE WHEN old IS NULL THEN NULL ELSE coalesce(ga[osrc + 1] = gb[old + 1] AND gb[old + 1] <> -1, false) END AS was,
                CASE WHEN old IS NULL THEN NULL ELSE coalesce(ga[nsrc + 1] = gb[new + 1] AND gb[new + 1] <> -1, false) END AS is_
         FROM (SELECT *, CASE WHEN cur >= 0 AND nxt >= 0 AND cur <> nxt THEN cur WHEN cur < 0 AND nxt >= 0 THEN bdst WHEN cur >= 0 AND nxt < 0 AND lnow >= 0 AND lnext >= 0 AND lnow <> lnext THEN cur END AS old,
                 CASE WHEN cur >= 0 AND nxt < 0 THEN lnow ELSE s END AS osrc, CASE WHEN cur >= 0 AND nxt < 0 THEN lnext ELSE s END AS nsrc, CASE WHEN nxt >= 0 THEN nxt ELSE cur END AS new,
                 CASE WHEN cur >= 0 AND nxt < 0 THEN lnext ELSE s END AS other, CASE WHEN cur >= 0 AND nxt >= 0 THEN t WHEN cur < 0 THEN bt ELSE t + 1 END AS since,
                 -- places of the left ports that a new link frees, back to its source's own earlier link, and of their right ports
                 CASE WHEN {targets} AND cur < 0 AND nxt >= 0 THEN list_filter([(t - q) * 10 + nxt + 1 for q in [1, 2, 3] if t - q >= 0 AND (bt IS NULL OR t - q > bt)], lambda i: l[i] >= 0 AND r[i - nxt + s] < 0) ELSE [] END AS held
          FROM (SELECT *, CASE WHEN cur < 0 AND nxt >= 0 THEN CASE WHEN t >= 1 AND b1 >= 0 AND b1 <> nxt THEN t - 1 WHEN t >= 2 AND b2 >= 0 AND b2 <> nxt THEN t - 2 WHEN t >= 3 AND b3 >= 0 AND b3 <> nxt THEN t - 3 END END AS bt,
                  CASE WHEN cur < 0 AND nxt >= 0 THEN CASE WHEN t >= 1 AND b1 >= 0 AND b1 <> nxt THEN b1 WHEN t >= 2 AND b2 >= 0 AND b2 <> nxt THEN b2 WHEN t >= 3 AND b3 >= 0 AND b3 <> nxt THEN b3 END END AS bdst,
                  CASE WHEN cur >= 0 THEN l[10 * t + cur + 1] END AS lnow, CASE WHEN cur >= 0 THEN l[10 * t + cur + 11] END AS lnext
           FROM (SELECT *, k // 10 AS t, k % 10 AS s, r[k + 1] AS cur, r[k + 11] AS nxt, CASE WHEN k >= 10 THEN r[k - 9] END AS b1, CASE WHEN k >= 20 THEN r[k - 19] END AS b2, CASE WHEN k >= 30 THEN r[k - 29] END AS b3
                 FROM fold WHERE k < 230)))), LATERAL (SELECT list_transform(held, lambda i: (i - 1) // 10 * 10 + l[i] + 1) AS freed)))),
done AS (SELECT CAST(i // 10 AS INT) AS step, CAST(x * 10 + i % 10 AS INT) AS node, r[i + 1] AS r, l[i + 1] AS l, x FROM fold, range(240) AS q(i) WHERE k = 230),
stays AS (SELECT step, node AS src, CAST((x + 1) * 10 + r AS INT) AS dst FROM done WHERE r >= 0),
known AS (SELECT step, CAST(x * 10 + l AS INT) AS src, CAST(node + 10 AS INT) AS dst FROM done WHERE l >= 0)"""
_REGIONS, _PLAIN, _TARGETS = (_STATE.format(regions=a, targets=b) for a, b in (("true", "false"), ("false", "false"), ("false", "true")))

_PENDING = """, d2 AS (SELECT CAST(s AS INT) AS step, id AS src, dst FROM node CROSS JOIN range(24) AS r(s) LEFT JOIN {0} AS k ON k.step = s AND k.src = id),
n2 AS (SELECT *, lead(dst) OVER (PARTITION BY src ORDER BY step) AS new FROM d2),
spread AS (SELECT src, new, step AS origin, unnest(generate_series(greatest(0, step - 2), step)) AS s FROM n2 WHERE dst IS NULL AND new IS NOT NULL),
pend AS (SELECT CAST(s AS INT) AS step, src, new AS dst FROM spread QUALIFY row_number() OVER (PARTITION BY s, src ORDER BY origin DESC) = 1)"""


def _resolved(spark: SparkSession, sf_dir: str, regions: bool = False, targets: bool = False) -> DataFrame:
    labels = grid.labelled(grid.nodes(spark, C).select("id"), fx.rects(spark), C) if regions else None
    return conflicts.resolved_in_order(fx.links(spark, sf_dir), labels, B, 0, T, targets)


def _rights(sides: DataFrame) -> DataFrame:
    return sides.where("side = 'right'").select("step", "src", "dst")


def _with_pending(spark: SparkSession, kept: DataFrame) -> DataFrame:
    coming = links.pending(links.filled(kept, spark, C, 0, T), B, 0)
    return kept.withColumn("kind", F.lit("works")).unionByName(coming.select("step", "src", "dst", F.lit("is set up").alias("kind")))


@plan(f"{_REGIONS}{_PENDING.format('stays')} SELECT step, src, dst, 'works' AS kind FROM stays UNION ALL SELECT step, src, dst, 'is set up' FROM pend")
def resolve_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With regions, whose links come first; also the links that are being set up."""
    return _with_pending(spark, _rights(_resolved(spark, sf_dir, regions=True)))


@plan(f"{_PLAIN} SELECT step, src, dst FROM stays")
def resolve_in_order_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rights(_resolved(spark, sf_dir))


# Chains of links that end at one step, walked by plane: a link is kept up if the one that ends at its source is not.
_EXTEND = """, d3 AS (SELECT CAST(s AS INT) AS step, id AS src, dst FROM node CROSS JOIN range(24) AS r(s) LEFT JOIN stays AS k ON k.step = s AND k.src = id),
n3 AS (SELECT *, lead(dst) OVER (PARTITION BY src ORDER BY step) AS new FROM d3),
busy AS (SELECT DISTINCT step, src FROM stays UNION SELECT step, dst FROM stays),
e AS (SELECT step, src, dst FROM n3 WHERE dst IS NOT NULL AND new IS NULL AND step < 23),
g AS (SELECT * FROM (SELECT e.step, e.src, e.dst, coalesce((SELECT min(b.step) FROM busy AS b WHERE b.step > e.step AND b.src IN (e.src, e.dst)), 24) - 4 AS last FROM e) WHERE last > step),
gk AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY src) AS n FROM g),
walk AS (SELECT step, n, [src, dst] AS used, [n] AS taken FROM gk WHERE n = 1
  UNION ALL SELECT w.step, k.n, CASE WHEN list_has_any(w.used, [k.src, k.dst]) THEN w.used ELSE list_concat(w.used, [k.src, k.dst]) END,
    CASE WHEN list_has_any(w.used, [k.src, k.dst]) THEN w.taken ELSE list_append(w.taken, k.n) END FROM walk AS w JOIN gk AS k ON k.step = w.step AND k.n = w.n + 1),
ends AS (SELECT step, taken FROM walk QUALIFY n = max(n) OVER (PARTITION BY step)),
longer AS (SELECT step, src, dst FROM stays UNION ALL SELECT CAST(unnest(generate_series(gk.step + 1, last)) AS INT), src, dst FROM gk JOIN ends ON ends.step = gk.step AND list_contains(taken, n))"""


def _extended(spark: SparkSession, kept: DataFrame) -> DataFrame:
    return kept.unionByName(conflicts.extended_in_order(kept, spark, C, B, 0, T))


@plan(f"{_PLAIN}{_EXTEND} SELECT step, src, dst FROM longer")
def resolve_in_order_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extended(spark, _rights(_resolved(spark, sf_dir)))


@plan(f"""{_TARGETS}{_EXTEND}, more AS (SELECT * FROM longer EXCEPT SELECT * FROM stays)
SELECT CAST(s AS INT) AS step, id AS node, r.dst AS right_node, coalesce(a.src, b.src) AS left_node FROM node CROSS JOIN range(24) AS q(s)
LEFT JOIN longer AS r ON r.step = s AND r.src = id LEFT JOIN more AS a ON a.step = s AND a.dst = id LEFT JOIN known AS b ON b.step = s AND b.dst = id""")
def resolve_in_order_with_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node at every step with its neighbours on both sides, as its own ports know them."""
    sides = _resolved(spark, sf_dir, targets=True)
    more = conflicts.extended_in_order(_rights(sides), spark, C, B, 0, T)
    right = _rights(sides).unionByName(more).select("step", F.col("src").alias("node"), F.col("dst").alias("right_node"))
    left = sides.where("side = 'left'").select("step", "src", "dst").unionByName(more).select("step", F.col("dst").alias("node"), F.col("src").alias("left_node"))
    every = grid.nodes(spark, C).select(F.explode(F.sequence(F.lit(0), F.lit(T - 1))).alias("step"), F.col("id").alias("node"))
    return every.join(right, ["step", "node"], "left").join(left, ["step", "node"], "left")
