"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact headers of every record are stored apart. Original
records come back by joining both. Of records with equal payloads the one with the largest page id is the response
and the others are revisits of it.

All of it is DataFrame operations: one shuffle of the payloads to find equal ones (copies meet on the map side
already). Payloads and the headers of responses are then tables with the same buckets by digest, so they are joined
without another shuffle, one row each; revisits carry no payload and find their response by its record id in a join of
small rows, which adaptive execution can split. Pages find the response of their payload by digest. Payloads of more
than one in ``HEAVY`` of the pages, which are fewer than ``HEAVY``, are broadcast for that, so no task gets all copies of
an empty page or an error page. Buckets are as many as the payloads' bytes ask for.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored as stored_table

#: Fixed values of the format: RFC 4648's base-32 letters against the digits of conv().
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
#: A payload is heavy if more than this part of the pages have it. Bytes of payloads in a bucket, on average.
HEAVY, BUCKET_BYTES = 1024, 256 << 20
NEWLINE = "\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: twenty bits, which are five hex digits, give four letters."""
    hexes = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexes, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


PAYLOADS = "sha256 string, payload binary, response struct<page_id:bigint,url:string>"
RESPONSES = "sha256 string, page_id bigint, warc_header string, http_header string"
REVISITS = "page_id bigint, sha256 string, warc_header string, http_header string"


def _name(path: str, part: str) -> str:
    return f"warc_{hashlib.md5(path.encode()).hexdigest()}_{part}"


def _write(df: DataFrame, path: str, part: str, buckets: int) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {_name(path, part)}")
    df.write.mode("overwrite").format("parquet").option("path", f"{path}/{part}").option("compression", "zstd").bucketBy(buckets, "sha256").saveAsTable(_name(path, part))


def _open(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """A table of the archive with its buckets; one that another session wrote is entered into the catalog first."""
    if not spark.catalog.tableExists(_name(path, part)):
        buckets = spark.read.schema("buckets int").json(f"{path}/layout").first().buckets
        spark.sql(f"CREATE TABLE {_name(path, part)} ({schema}) USING parquet CLUSTERED BY (sha256) INTO {buckets} BUCKETS LOCATION '{path}/{part}'")
    return spark.table(_name(path, part))


def write_archive(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0, date: str = DATE) -> None:
    """Writes ``path``/payloads, ``path``/responses and ``path``/revisits, replacing what is there.

    A null ``body`` is an empty payload; bodies may be as long as a row can be. Payloads under ``least_bytes`` bytes are
    never revisited. Rows that repeat the largest page id of their payload are responses as well, and revisits name the
    one with the greatest url; a null page id is a response only if no id is known. Repeated rows are records of their
    own, with ids of their own. An empty table gives an empty archive; other columns are ignored.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    facts = rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    # the copies of a repeated row are numbered
    facts = stored_table(facts.groupBy(*facts.columns).agg(F.count("*").alias("copies")))
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, n_bytes = facts.agg(F.count("*"), F.sum(F.col("n"))).first()
    buckets = dealt * max(1, -(-(n_bytes or 0) // (dealt * BUCKET_BYTES)))  # a multiple of the tasks that the shuffle by digest deals to, so a bucket is one file
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/layout")
    _write(rows.groupBy("sha256").agg(F.any_value("payload").alias("payload"), F.max(F.struct("page_id", "url")).alias("response")), path, "payloads", buckets)

    stored = _open(spark, path, "payloads", PAYLOADS).select("sha256", "response")
    heavy = [r.sha256 for r in facts.groupBy("sha256").count().where(F.col("count") * HEAVY > total).collect()]
    many = F.col("sha256").isin(heavy)
    found = facts.where(~many).join(stored.where(~many), "sha256").unionByName(facts.where(many).join(F.broadcast(stored.where(many)), "sha256")) if heavy else facts.join(stored, "sha256")
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    known = F.col("response.page_id")
    revisit = (F.col("n") >= least_bytes) & F.coalesce(F.col("page_id") != known, known.isNotNull())
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{NEWLINE}Content-Type: text/html; charset=utf-8{NEWLINE}Content-Length: "), F.col("n"), F.lit(NEWLINE * 2))
    block = F.octet_length("http_header") + F.when(F.col("revisit"), 0).otherwise(F.col("n"))

    def address(c: str) -> Column:
        return F.coalesce(F.regexp_replace(c, "[\r\n]", ""), F.lit(""))

    refers = F.concat(
        F.lit(f"{NEWLINE}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{NEWLINE}WARC-Refers-To: <"),
        _uuid(known, F.col("response.url"), F.col("sha256"), F.lit(1)),
        F.lit(f">{NEWLINE}WARC-Refers-To-Target-URI: "),
        address("response.url"),
        F.lit(f"{NEWLINE}WARC-Refers-To-Date: {date}"),
    )
    header = F.concat(
        F.lit(f"WARC/1.1{NEWLINE}WARC-Type: "),
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit(f"{NEWLINE}WARC-Record-ID: <"),
        _uuid(F.col("page_id"), F.col("url"), F.col("sha256"), F.col("copy")),
        F.lit(f">{NEWLINE}WARC-Date: {date}{NEWLINE}WARC-Target-URI: "),
        address("url"),
        F.lit(f"{NEWLINE}WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(F.col("revisit"), refers).otherwise(""),
        F.lit(f"{NEWLINE}Content-Type: application/http; msgtype=response{NEWLINE}Content-Length: "),
        block.cast("string"),
        F.lit(NEWLINE * 2),
    )
    records = found.withColumns({"revisit": revisit, "http_header": http}).withColumn("warc_header", header)
    records = stored_table(records.select("page_id", "sha256", "revisit", "warc_header", "http_header"))
    _write(records.where("NOT revisit").select("sha256", "page_id", "warc_header", "http_header").repartition(buckets, "sha256"), path, "responses", buckets)
    records.where("revisit").select("page_id", "sha256", "warc_header", "http_header").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/revisits")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``sha256, payload`` as stored; reading fails if bytes do not have their digest."""
    good = F.sha2("payload", 256) == F.col("sha256")
    damaged = F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256")))
    return _open(spark, path, "payloads", PAYLOADS).select("sha256", F.when(good, F.col("payload")).otherwise(damaged).alias("payload"))


def _field(name: str) -> Column:
    return F.regexp_extract("warc_header", f"{NEWLINE}{name}: <?([^\r\n>]*)", 1)


def _record(payload: Column) -> Column:
    return F.concat(F.col("warc_header").cast("binary"), F.col("http_header").cast("binary"), payload, F.lit(b"\r\n\r\n"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_id, sha256, head, record`` of each response: its exact bytes, and how many come before the payload."""
    headers = _open(spark, path, "responses", RESPONSES)
    head = F.octet_length("warc_header") + F.octet_length("http_header")
    return headers.join(read_payloads(spark, path), "sha256").select("page_id", _field("WARC-Record-ID").alias("record_id"), "sha256", head.alias("head"), "warc_header", _record(F.col("payload")).alias("record"))


def read_revisits(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, record_id, refers_id, sha256, record`` of each revisit: its exact bytes and the response's record id."""
    headers = spark.read.schema(REVISITS).parquet(f"{path}/revisits")
    return headers.select("page_id", _field("WARC-Record-ID").alias("record_id"), _field("WARC-Refers-To").alias("refers_id"), "sha256", _record(F.lit(b"")).alias("record"))


def _payload_of(record: Column, head: Column) -> Column:
    return F.substring(record, head + 1, F.octet_length(record) - head - 4)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records: ``page_id, record_id, record_type, refers_to, payload`` and ``record``, the record's exact bytes.

    ``refers_to`` is the page id of the response that a revisit refers to. A revisit's record has no payload of its
    own; ``payload`` is that of its response. An empty archive gives no rows.
    """
    responses = read_responses(spark, path)
    none = F.lit(None).cast("long").alias("refers_to")
    own = responses.select("page_id", "record_id", F.lit("response").alias("record_type"), none, _payload_of(F.col("record"), F.col("head")).alias("payload"), "record")
    named = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), _payload_of(F.col("record"), F.col("head")).alias("payload"))
    others = read_revisits(spark, path).join(named, "refers_id")
    return own.unionByName(others.select("page_id", "record_id", F.lit("revisit").alias("record_type"), "refers_to", "payload", "record"))


def record_digests(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, from the rebuilt records.

    The payload is cut out of each rebuilt response and measured; one whose header names another digest or length
    fails. Revisits take these of the response that they refer to by its record id, so no bytes travel.
    """
    payload = _payload_of(F.col("record"), F.col("head"))
    named = [_field("WARC-Payload-Digest").alias("named_digest"), _field("Content-Length").cast("long").alias("named_length")]
    built = read_responses(spark, path).select("page_id", "record_id", *named, F.octet_length("record") - F.octet_length("warc_header") - 4, F.octet_length(payload).cast("long"), base32_sha1(payload))
    built = built.toDF("page_id", "record_id", "named_digest", "named_length", "block", "payload_bytes", "payload_digest")
    good = (F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("named_digest")) & (F.col("block") == F.col("named_length"))
    digest = F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record differs from its header")))
    measured = stored_table(built.select("page_id", "record_id", "payload_bytes", digest.alias("payload_digest")))
    facts = measured.select(F.col("record_id").alias("refers_id"), "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    own = measured.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")})
    return own.select(*columns).unionByName(read_revisits(spark, path).join(facts, "refers_id").withColumn("record_type", F.lit("revisit")).select(*columns))
