"""Exact duplicates through an extendible-hash index on shared files.

1. Every document is logged in the shared folder: its text without white space, a 64-bit hash of that, the *key*, and
   its SHA-256.
2. The index's directory grows by doubling. A bucket is the range of keys that begin with certain bits; one that holds
   more text than its capacity is split by one bit more, for which the directory doubles. Runs of neighbouring buckets
   that fit together go to one owner task, which so has one range of keys.
3. An owner brings what it gets together by key and text, so texts are compared byte by byte, and texts that differ but
   collide in their key are chained as entries of their own. Entries go to files in the shared folder, each with the
   number of its rows and the row that stays.
4. The log's rows find their entry by key and SHA-256. That these name one entry only is checked: the work fails if
   entries that differ in their bytes have both in common.

Splitting does not help where copies of one text fill a bucket. So keys of more than one in ``HEAVY`` of all rows, which are
fewer than ``HEAVY``, do not go to owners: their copies are combined on the map side before any of them moves, and
entries of as many rows, fewer than ``HEAVY`` too, are broadcast to their rows. Besides these, only sums of overfull
buckets and the directory (``1 << DEPTH`` pointers at most) reach the driver or are broadcast, whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of text that a bucket and an owner task hold, and the most buckets: in larger tables buckets hold more.
CAPACITY, OWNER, BUCKETS = 4 << 20, 16 << 20, 1 << 16
#: Depth to which the directory can double.
DEPTH = 18
#: A key, or an entry, is heavy if it has more than this part of the rows.
HEAVY = 1024
#: White space that texts are compared without.
SPACE = r"[\x20\x09-\x0D]+"


def _cell(key: str, depth: int = DEPTH) -> Column:
    """The first ``depth`` bits of a key as a number."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def doubled(sums: DataFrame, capacity: int, first: int = 0, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """Buckets ``(bits, number of bits, bytes)`` in the order of keys, from the rows ``cell, bytes`` of ranges of ``depth`` bits.

    Starts from ``1 << first`` buckets. While buckets hold over ``capacity`` bytes they are split by one bit more; at the full
    depth they stay as they are. Each round reads the sums of overfull buckets alone, at most two rows for each.
    """
    spark, done, parents, d = sums.sparkSession, [], None, first
    while True:
        at = sums.withColumn("b", F.shiftright("cell", depth - d))
        if parents is not None:
            split = spark.createDataFrame([(p,) for p in parents], "p int")
            at = at.join(F.broadcast(split), F.shiftright("b", 1) == F.col("p"), "left_semi")
        held = {r.b: r.bytes for r in at.groupBy("b").agg(F.sum("bytes").alias("bytes")).collect()}
        buckets = range(1 << first) if parents is None else [2 * p + k for p in parents for k in (0, 1)]
        full = [b for b in buckets if held.get(b, 0) > capacity and d < depth]
        done += [(b, d, held.get(b, 0)) for b in sorted(set(buckets).difference(full))]
        if not full:
            return sorted(done, key=lambda b: b[0] << (depth - b[1]))
        parents, d = full, d + 1


def owners(buckets: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The owner of each bucket: neighbours go together while they fit."""
    out, owner, held = [], 0, 0
    for _, _, size in buckets:
        if held and held + size > capacity:
            owner, held = owner + 1, 0
        held += size
        out.append(owner)
    return out


def _entries(rows: DataFrame, *task: str) -> DataFrame:
    """An entry for each different text: ``key, norm, sha, n_rows`` and the greatest ``(n, id, row)``, which stays."""
    return rows.groupBy(*task, "key", "norm").agg(F.any_value("sha").alias("sha"), F.count("*").alias("n_rows"), F.max(F.struct("n", "id", "row")).alias("keep"))


def _logged(docs: DataFrame, key: str, text: str, bits: int, carry: bool) -> DataFrame:
    given = F.coalesce(docs[text].cast("string"), F.lit(""))
    carried = [F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("carried")] if carry else []
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.length(given).alias("n"), F.regexp_replace(given, SPACE, "").alias("norm"), *carried)
    hashed = F.shiftleft(F.shiftrightunsigned(F.xxhash64("norm"), 64 - bits), 64 - bits)
    # ~id orders ids from the least one up without overflow, and null ids last
    added = {"row": F.monotonically_increasing_id(), "id": F.bitwise_not("doc_id"), "key": hashed, "sha": F.unhex(F.sha2("norm", 256))}
    return stored(rows.withColumns(added))


def build_index(log: DataFrame, heavy: list[int], capacity: int | None = None) -> DataFrame:
    """The index of a log in the shared folder: ``owner, bucket, key, norm, sha, n_rows, keep``; heavy keys have owner and bucket -1."""
    spark = log.sparkSession
    light = log.where(~F.col("key").isin(heavy)) if heavy else log
    sums = stored(light.groupBy(_cell("key").alias("cell")).agg(F.sum(F.octet_length("norm").cast("long") + 64).alias("bytes")))
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    capacity = capacity or max(CAPACITY, total // BUCKETS)
    buckets = doubled(sums, capacity, min(DEPTH, max(0, (total // capacity).bit_length() - 2)))
    whose = owners(buckets, max(capacity, OWNER))
    ranges = [(b << (DEPTH - d), (b + 1 << (DEPTH - d)) - 1, k, whose[k]) for k, (b, d, _) in enumerate(buckets)]
    directory = spark.createDataFrame(ranges, "low int, high int, bucket int, owner int").select(F.explode(F.sequence("low", "high")).alias("cell"), "bucket", "owner")
    dealt = light.select(_cell("key").alias("cell"), "key", "norm", "sha", "n", "id", "row").join(F.broadcast(directory), "cell")
    entries = _entries(dealt.repartitionById(whose[-1] + 1, "owner"), "owner", "bucket")
    if heavy:
        combined = _entries(log.where(F.col("key").isin(heavy)))
        entries = entries.unionByName(combined.withColumns({"owner": F.lit(-1), "bucket": F.lit(-1)}))
    return stored(entries)


def _grouped(log: DataFrame, capacity: int | None) -> DataFrame:
    """The log's rows with ``n_rows`` and ``keep`` of their entry."""
    rows = log.count()
    heavy = [r.key for r in log.groupBy("key").count().where(F.col("count") * HEAVY > rows).collect()]
    entries = build_index(log, heavy, capacity).select("key", "sha", "n_rows", "keep")
    if not entries.groupBy("key", "sha").count().where("count > 1").isEmpty():
        raise ValueError("texts that differ have one SHA-256")
    many = F.col("n_rows") * HEAVY > rows
    log = log.drop("norm")
    if not heavy:
        return log.join(entries, ["key", "sha"])
    large = F.broadcast(entries.where(many))  # fewer than HEAVY
    return log.join(large, ["key", "sha"]).unionByName(log.join(large, ["key", "sha"], "left_anti").join(entries.where(~many), ["key", "sha"]))


def exact_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int | None = None, bits: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of ``docs``.

    Texts are equal if they are without white space; a null text is an empty one, and texts may be as long as a row can be.
    Of a group the row with the most code points stays, then that of the smallest id, with null ids last; of rows that
    repeat these too, one stays. An empty table gives no rows; other columns are ignored, whatever their names.
    ``capacity`` is what a bucket holds, and ``bits`` how many bits of a key are used: with few of them keys collide.
    """
    found = _grouped(_logged(docs, key, text, bits, False), capacity)
    kept = F.col("row") == F.col("keep.row")
    return found.select("doc_id", F.bitwise_not("keep.id").alias("keep_id"), F.col("n_rows").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; cases as in ``exact_duplicates``."""
    return _grouped(_logged(docs, key, text, 64, True), capacity).where("row = keep.row").select("carried.*")
