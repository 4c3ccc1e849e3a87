"""Where queries and their SQL equivalents are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that the SQL equivalents start with: the small constellation and who sees it.
WITH = """
WITH RECURSIVE vis AS (
  SELECT DISTINCT CAST(hour(ts) AS INT) AS step, CAST(event_id % 20 AS INT) AS station_id,
         CAST((((event_id % 20) // 2 + user_id % 2) % 10) * 10 + ((event_id % 20) * 3 + hour(ts) + user_id % 3) % 10 AS INT) AS sat_id
  FROM events),
gv AS (SELECT DISTINCT step, sat_id, CASE WHEN station_id <= 3 THEN 0 WHEN station_id <= 8 THEN 1 WHEN station_id = 9 THEN 2
         WHEN station_id = 10 THEN 3 WHEN station_id <= 14 THEN 4 WHEN station_id <= 16 THEN 5 ELSE 6 END AS gid FROM vis),
off AS (SELECT step, CAST(CASE WHEN min(sat_id % 10) <> 0 THEN max(sat_id % 10) ELSE max(CASE WHEN sat_id % 10 <= 5 THEN sat_id % 10 END) END AS INT) AS offs
        FROM gv WHERE gid = 0 GROUP BY step),
node AS (SELECT CAST(range AS INT) AS id, CAST(range // 10 AS INT) AS x, CAST(range % 10 AS INT) AS y FROM range(100)),
ring AS (SELECT id AS src, CAST(x * 10 + (y + d + 10) % 10 AS INT) AS dst FROM node, (VALUES (1), (-1)) AS v(d)),
rect(gid, xmin, xmax, ymin, ymax, option) AS (VALUES (0, 0, 6, 2, 6, 0), (4, 5, 9, 1, 8, 1)),
motif AS (SELECT DISTINCT CAST(x * 10 + y AS INT) AS src, CAST(nx * 10 + ny AS INT) AS dst
          FROM (SELECT node.x, node.y, r.*, node.x + 1 AS nx, CASE WHEN option = 0 THEN node.y ELSE (node.y + 9) % 10 END AS ny
                FROM node, rect AS r WHERE node.x BETWEEN xmin AND xmax AND node.y BETWEEN ymin AND ymax) AS q
          WHERE nx BETWEEN xmin AND xmax AND ny BETWEEN ymin AND ymax),
seen AS (SELECT sat_id, count(*) AS often FROM vis GROUP BY sat_id),
imp AS (SELECT id, coalesce(often, 0) / 40 AS importance FROM node LEFT JOIN seen ON sat_id = id),
sn AS (SELECT DISTINCT step, sat_id AS id, CAST(sat_id // 10 AS INT) AS x, CAST(sat_id % 10 AS INT) AS y FROM gv),
pick AS (SELECT src, max(dst) AS dst FROM motif GROUP BY src),
link AS (SELECT step, CAST(src // 10 * 10 + (src % 10 + offs + step // 3 + 1) % 10 AS INT) AS src, CAST(dst // 10 * 10 + (dst % 10 + offs + step // 3 + 1) % 10 AS INT) AS dst
         FROM pick, off)
"""


def plan(sql: str | None = None, prefix: str = WITH) -> Callable:
    """Registers a query under its function's name, with its SQL (after the common table expressions) if there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = prefix + sql
        return f

    return add
