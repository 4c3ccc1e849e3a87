import base64
import hashlib
import re

import pytest

from skylattice.llm import warc_archive
from skylattice.llm.warc_archive import PAYLOADS, _name, _write, read_records, record_digests, write_archive


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


ROWS = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "<p>é</p>"), (3, None, None), (4, "http://b/\r\nz", ""), (5, "u", "long " * 40_000), (7, "v", "<p>é</p>"), (7, "v", "<p>é</p>"), (8, "w", "alone")]


def expected(least):
    by = {}
    for i, _, h in ROWS:
        by.setdefault((h or "").encode(), []).append(i)
    out = []
    for i, _, h in ROWS:
        payload = (h or "").encode()
        top = max(by[payload])
        revisit = i != top and len(payload) >= least
        out.append((i, len(payload), digest(payload), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1])
def test_records_come_back(spark, tmp_path, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "'y' AS sha256")
    write_archive(pages, str(tmp_path / "w"), least_bytes=least)
    assert sorted(map(tuple, record_digests(spark, str(tmp_path / "w")).collect()), key=str) == expected(least)
    html = {i: (h or "").encode() for i, _, h in ROWS}
    records = read_records(spark, str(tmp_path / "w")).collect()
    assert len(records) == len(ROWS)
    for r in records:
        record, payload = bytes(r.record), bytes(r.payload)
        assert payload == html[r.page_id]
        head, _, rest = record.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        block = rest[:size]
        assert rest[size:] == b"\r\n\r\n"
        assert block.partition(b"\r\n\r\n")[2] == (payload if r.record_type == "response" else b"")
        assert f"sha1:{digest(payload)}".encode() in head
        assert f"WARC-Record-ID: <{r.record_id}>".encode() in head and r.record_id.startswith("urn:uuid:")
    by = {r.record_id: r for r in records}
    assert len(by) == len(ROWS)
    for r in records:
        refers = re.search(rb"WARC-Refers-To: <([^>]*)>", bytes(r.record))
        assert (refers is not None) == (r.record_type == "revisit")
        if refers:
            other = by[refers[1].decode()]
            assert other.record_type == "response" and other.page_id == r.refers_to and bytes(other.payload) == bytes(r.payload)
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len(set(html.values()))


def test_empty_table_and_damage(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    write_archive(pages.where("false"), str(tmp_path / "e"))
    assert record_digests(spark, str(tmp_path / "e")).count() == 0
    write_archive(pages, str(tmp_path / "d"))
    bad = spark.read.parquet(str(tmp_path / "d/payloads")).selectExpr("sha256", "cast(concat(cast(payload AS string), '!') AS binary) AS payload", "response").collect()
    buckets = spark.read.json(str(tmp_path / "d/layout")).first().buckets
    _write(spark.createDataFrame(bad, PAYLOADS).repartition(buckets, "sha256"), str(tmp_path / "d"), "payloads", buckets)
    with pytest.raises(Exception, match="damaged payload"):
        record_digests(spark, str(tmp_path / "d")).collect()


def test_an_archive_opens_in_another_session(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path)
    for part in ("payloads", "responses"):
        spark.sql(f"DROP TABLE {_name(path, part)}")
    assert sorted(map(tuple, record_digests(spark, path).collect()), key=str) == expected(0)


def test_null_ids_and_ties(spark, tmp_path):
    rows = [(None, "a", "x"), (None, "b", "x"), (None, "a", "y"), (3, "a", "y"), (3, "b", "y"), (3, None, "y")]
    write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = [(r.page_id, bytes(r.payload), r.record_type, r.refers_to) for r in read_records(spark, str(tmp_path / "w")).collect()]
    assert sorted(got, key=str) == sorted([(None, b"x", "response", None)] * 2 + [(None, b"y", "revisit", 3)] + [(3, b"y", "response", None)] * 3, key=str)


def test_a_third_of_the_pages_are_one_payload(spark, tmp_path, monkeypatch):
    """No task reads all pages of the hot payload, clashing columns do no harm, and large archives have more buckets."""
    monkeypatch.setattr(warc_archive, "HEAVY", 8)
    monkeypatch.setattr(warc_archive, "BUCKET_BYTES", 2000)
    rows = [(i, f"http://h/{i}", "the same error page" if i % 3 == 0 else f"page {i} " * 5) for i in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6).selectExpr("*", "'x' AS copies", "1 AS n", "'y' AS sha1", "2 AS response", "'z' AS revisit")
    write_archive(pages, str(tmp_path / "w"))
    got = sorted(map(tuple, record_digests(spark, str(tmp_path / "w")).collect()))
    want = [(i, len(h), digest(h.encode()), "revisit" if i % 3 == 0 and i != 897 else "response", 897 if i % 3 == 0 and i != 897 else None) for i, _, h in rows]
    assert got == sorted(want)
    assert spark.read.json(str(tmp_path / "w/layout")).first().buckets == 4 * -(-sum(len(h) for _, _, h in rows) // 8000)


def test_where_pages_find_their_response_heavy_payloads_are_broadcast(spark, tmp_path):
    seen = []
    stored = warc_archive.stored_table

    def spy(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    warc_archive.stored_table = spy
    try:
        write_archive(spark.createDataFrame([(i, "u", "hot" if i % 3 else str(i)) for i in range(3000)], "page_id long, url string, html string"), str(tmp_path / "w"))
    finally:
        warc_archive.stored_table = stored
    assert "strategy=broadcast" in seen[-1] and "Union" in seen[-1]
