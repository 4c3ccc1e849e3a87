"""Hard negatives against plain Python over all pairs, and the bounds that candidates are filtered by."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skylattice.llm import hard_negatives as hn
from skylattice.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    part = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, c in (r for r in part if r[0] % every == 0):
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, d) for j, v, d in part if j != i)
        for s, j, _ in [x for x in scored if x[2] == c][:positives]:
            inside = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def rows_of(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middle)], rng.randint(0, 3)) for i in range(n)]


@pytest.mark.parametrize(("dim", "spread", "least"), [(16, 1.0, 2048), (7, 0.2, 40), (1, 1.0, 40)])
def test_equals_plain_python(spark, dim, spread, least, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_BLOCK", least)
    rows = rows_of(600, dim, dim, spread)
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_ties_nulls_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_BLOCK", 16)
    rng = random.Random(1)
    some = [[1.0, 0.5, 0.0], [0.9, 0.5, 0.1], [0.6, 0.4, 0.0], [-1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.5]]
    rows = [(i, rng.choice(some), rng.randint(0, 2)) for i in range(200)]
    rows += [(200, None, 1), (250, [1.0, None], 1), (300, [1.0, float("nan"), 0.0], 1), (350, [float("inf")], 0), (400, [1.0, 0.5, 0.0], None), (None, [1.0], 1), (450, [], 1), (500, [1.0, 1.0], 7)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS row", "'y' AS block", "1 AS score", "2 AS q", "'z' AS positives")
    assert sorted(map(tuple, hn.hard_negatives(docs, F.col("id") % 50 == 0).collect())) == brute(rows)


def test_an_empty_table_and_scores_that_are_too_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.hard_negatives(empty, F.col("id") % 50 == 0).count() == 0
    with pytest.raises(ValueError, match="not exact"):
        hn.hard_negatives(spark.createDataFrame([(0, [1e300], 1)], SCHEMA), F.col("id") % 50 == 0)


def test_a_repeated_id_is_two_anchors(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.7, 0.8], 2)]
    got = sorted(map(tuple, hn.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0).collect()))
    assert got == [(0, 1, 1, 2, 65536, 256 * 179), (0, 1, 1, 2, 65536, 256 * 204)]


def test_scores_lie_within_their_bounds():
    rng = np.random.default_rng(5)
    q = rng.integers(-300, 300, (3000, 12))
    books = hn.fitted(q[:1000])
    codes, norms = hn.encoded(q, books)
    lower, upper = hn.bounds(q[:40], books, codes, norms)
    score = q[:40] @ q.T
    assert (lower <= score).all() and (score <= upper).all()
    assert (upper - lower).mean() < 0.4 * (score.max() - score.min())


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.1/embeddings.parquet'")
    got = QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.1")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op13_hard_negatives']})").fetchall()
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == sorted(want)
