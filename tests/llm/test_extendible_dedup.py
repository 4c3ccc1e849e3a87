"""Exact dedup against plain Python, with keys that collide, hot groups and edge cases."""

import hashlib
import random
import re

import pytest

from skylattice.llm import extendible_dedup
from skylattice.llm.extendible_dedup import doubled, exact_dedup, exact_duplicates, owners

SCHEMA = "doc_id long, text string"


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        first = sum(m[:3] == best[:3] for m in members)
        for m in members:
            out.append((m[4], best[4], len(members), m[:3] == best[:3] and first == 1, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    rows = [(i, f"text {rng.randint(0, 120)} of\t{rng.choice(['some', 'so me', 'so\nme', 'so  me '])} kind") for i in range(400)]
    rows += [(1000 + i, "the hot one" + " " * (i % 3)) for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n\x0b\x0c\r"), (2003, " "), (2004, "long " * 200_000), (2005, "long" * 200_000), (None, "nameless"), (3, "nameless"), (None, "only nameless")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("bits", "capacity"), [(64, None), (64, 2000), (2, None), (6, 3000)])
def test_equals_plain_python(spark, bits, capacity, monkeypatch):
    monkeypatch.setattr(extendible_dedup, "OWNER", 4000 if capacity else 1 << 24)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "'x' AS key", "1 AS row", "'y' AS norm", "2 AS bucket")
    got = sorted((tuple(r) for r in exact_duplicates(docs, capacity=capacity, bits=bits).collect()), key=str)
    assert got == brute(rows)


def test_the_index_chains_texts_that_collide(spark):
    log = extendible_dedup._logged(spark.createDataFrame([(i, f"t{i % 50}") for i in range(200)], SCHEMA), "doc_id", "text", 1, False)
    found = extendible_dedup.build_index(log, [], 500).collect()
    assert len({r.key for r in found}) == 2 and len(found) == 50 and {r.n_rows for r in found} == {4} and len({r.norm for r in found}) == 50
    # a range of keys has one bucket and one owner
    assert all(len({(r.owner, r.bucket) for r in found if r.key == k}) == 1 for k in {r.key for r in found})


def test_the_directory_doubles_where_buckets_are_overfull(spark):
    sums = spark.createDataFrame([(0, 10), (1, 10), (2, 90), (3, 5), (12, 40), (15, 41)], "cell int, bytes long")
    assert doubled(sums, 50, 0, 4) == [(0, 3, 20), (2, 4, 90), (3, 4, 5), (1, 2, 0), (2, 2, 0), (6, 3, 40), (7, 3, 41)]
    assert doubled(sums, 1000, 0, 4) == [(0, 0, 196)]
    assert doubled(sums.where("false"), 50, 1, 4) == [(0, 1, 0), (1, 1, 0)]
    assert owners([(0, 3, 20), (2, 4, 90), (3, 4, 5), (1, 2, 0), (6, 3, 40)], 50) == [0, 1, 2, 2, 2]


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "ab", "y"), (3, "c", "z"), (None, "c", "w")], f"{SCHEMA}, keep string")
    assert sorted(map(tuple, exact_dedup(docs).collect())) == [(1, "a b", "x"), (3, "c", "z")]
    assert [r.kept for r in exact_duplicates(docs).orderBy("doc_id").collect()].count(True) == 2


def test_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(empty).count() == 0 and exact_dedup(empty).count() == 0


def test_query_on_whole_table(spark):
    from skylattice.llm.queries import ORACLES, QUERIES
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = QUERIES["op12_exact_dedup"](spark, "/root/testdata/sf0.01")
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"SELECT {columns} FROM ({ORACLES['op12_exact_dedup']})").fetchall())
