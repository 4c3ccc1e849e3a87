"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at three or fewer differing bits. Cut into two segments of 32 bits, two such fingerprints have a
segment in which they differ by at most one bit. Every distinct fingerprint is therefore indexed under each segment
as it is, and under each segment with one bit made a wildcard; equality joins on these keys find all candidates, and
comparing whole fingerprints verifies them.

Only keys under which a pair can meet for the first time go on (an exact key with two fingerprints; a wildcard key
with both values of the wildcard bit). A key with very many fingerprints is cut into blocks, and each pair of blocks
is one bounded task: nothing is left out. Of a group only links to its least member are returned, as many as it has
members, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted
from .components import connected_components

SHINGLE, SEED = 3, 42
MOST_BITS = 3
SEGMENTS, SEGMENT_BITS = 2, 32
#: Fingerprints of one key that are compared together; larger groups are compared block by block.
BLOCK = 2048
#: Words of a shingle and least Jaccard index where a stage removes similar texts; bands and least values of each, which
#: find a pair at 0.8 with a chance of 0.996; sets compared together.
TEXT_SHINGLE, SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 24, 7
SET_BLOCK = 128
_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, size=BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint of a text as an unsigned number; zero without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of each row, ``fp`` as a signed long. Null texts are like empty ones."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _linked(found: np.ndarray) -> np.ndarray:
    """For each of a few fingerprints, the position of the least member of its component among them."""
    n = len(found)
    label = np.arange(n)
    while True:
        least = label.copy()
        for at in range(0, n, 256):
            near = np.bitwise_count(found[at : at + 256, None] ^ found[None, :]) <= MOST_BITS
            least[at : at + 256] = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for group in batch.column(0):
            found = np.sort(np.unique(np.asarray(group.values, dtype=np.int64)).view(np.uint64))
            if len(found) == 2:
                if (int(found[0]) ^ int(found[1])).bit_count() <= MOST_BITS:
                    a.append(found[:1])
                    b.append(found[1:])
                continue
            label = _linked(found)
            moved = label != np.arange(len(found))
            a.append(found[label[moved]])
            b.append(found[moved])
        empty = np.zeros(0, dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x]).view(np.int64)) for x in (a, b)], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that join all that differ by at most three bits."""
    # variant v of a segment: bit v is the wildcard, or none if v is SEGMENT_BITS
    variants = F.sequence(F.lit(0), F.lit(SEGMENTS * (SEGMENT_BITS + 1) - 1))
    # a fingerprint takes little room but becomes 66 rows: spread them first, by a hash of their own, as adaptive
    # execution would merge partitions by size
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(variants).alias("k")).selectExpr(
        "fp", "k", f"CAST(k % {SEGMENT_BITS + 1} AS INT) AS v", f"shiftrightunsigned(fp, CAST(k div {SEGMENT_BITS + 1} AS INT) * {SEGMENT_BITS}) & {2**SEGMENT_BITS - 1}L AS seg"
    )
    keyed = keyed.selectExpr(
        "fp",
        f"shiftleft(CAST(k AS BIGINT), {SEGMENT_BITS}) | IF(v = {SEGMENT_BITS}, seg, seg & ~shiftleft(1L, v)) AS key",
        f"IF(v = {SEGMENT_BITS}, NULL, shiftrightunsigned(seg, v) & 1L) AS bit",
    )
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"))
    # written first, so that the join can split the rows of a key with very many fingerprints
    open_keys = persisted(sizes.where("n > 1 AND (ones IS NULL OR ones BETWEEN 1 AND n - 1)").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # both sides grow with the table, so the join sorts whatever their estimates are: none goes through the driver
    cells = keyed.join(open_keys.hint("merge"), "key").select("key", "fp", mine.alias("i"), other.alias("j"))
    groups = cells.groupBy("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    return groups.select("fps").mapInArrow(_group_links, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row; fingerprint as 16 hex digits.

    Components are those of the graph of links between fingerprints; its id is the smallest ``doc_id`` in it (null if
    all are). Texts without words have fingerprint zero and are linked like any other. Rows that repeat an id are
    separate members. An empty table gives no rows; other columns are ignored.
    """
    found = persisted(fingerprints(docs, key=key, text=text))
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(fingerprint_links(distinct.select("fp"), block=block))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named.hint("merge"), "root").select("fp", "component_id")
    return found.join(classes.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct hashes of the runs of ``shingle`` words, sorted; shorter texts are one run, texts without words have none."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), dtype=np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band: texts share it if all ``BAND_ROWS`` least values of the band are equal."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * _FACTORS[None, :]).min(axis=0))
    bands = least.reshape(BANDS, BAND_ROWS)
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(bands)]


def _jaccard_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions that join all sets with a Jaccard index of ``similarity`` or more, at most one a set."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values, at = np.unique(np.concatenate(sets), return_inverse=True) if sizes.sum() else (np.zeros(0), np.zeros(0, np.int64))
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1  # a hash that one set has adds to no intersection
    columns = np.cumsum(shared) - 1
    both = np.zeros((n, n), dtype=np.int64)
    keep = shared[at]
    owner, column = owner[keep], columns[at[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = min(8192, int(shared.sum()))
    for first in range(0, int(shared.sum()), 8192):
        low, high = np.searchsorted(column, (first, first + 8192))
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[low:high], column[low:high] - first] = 1.0
        both += (part @ part.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    near = (both >= similarity * union - 1e-9) | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if np.array_equal(least, label):
            return [(int(x), i) for i, x in enumerate(label) if x != i]
        label = least


def fingerprint_candidates(classes: DataFrame) -> DataFrame:
    """``h, key`` for rows ``h, fp``: rows whose fingerprints are equal or linked by deletion variants share a key."""
    distinct = classes.select("fp").distinct()
    links = persisted(fingerprint_links(distinct).distinct())
    keys = links.select(F.col("b").alias("fp"), F.col("a").alias("key")).unionByName(distinct.select("fp", F.col("fp").alias("key")))
    return classes.join(keys.hint("merge"), "fp").select("h", "key")


def similar_components(docs: DataFrame, *, text: str, row: str, shingle: int = TEXT_SHINGLE, similarity: float = SIMILARITY, block: int = SET_BLOCK) -> DataFrame:
    """``h, first, root``: classes of equal word sequences, their first row, and the component of similar classes.

    ``row`` is a struct that orders the rows. Candidates are classes whose
    SimHash fingerprints the deletion variants link, and, as these reach three bits and similar texts may differ in more,
    classes that share a band key; those of keys with the same least member, their star, go together. Members are dealt to blocks, each with the star, and compared exactly
    within them. Those that come out linked to the star need no more: only members apart from it meet the other blocks.
    So a group of copies is sent once however large it is, and no link is lost in one that falls apart.
    """
    rows = docs.select(docs[row].alias("row"), docs[text].alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t) for t in batch.column(1).to_pylist()]
            names = [xxhash.xxh128_hexdigest(b" ".join(w)) for w in words]
            keys = [band_keys(shingle_hashes(w, shingle)) if w else [] for w in words]
            # no fingerprint without words: such texts are near-duplicates of none
            prints = [np.uint64(simhash(t)).astype(np.int64).item() if w else None for t, w in zip(batch.column(1).to_pylist(), words, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["row", "h", "fp", "bands"])

    found = rows.mapInArrow(sketch, f"row {kind}, h string, fp bigint, bands array<bigint>")
    classes = persisted(found.groupBy("h").agg(F.min("row").alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    keyed = fingerprint_candidates(classes.where("fp IS NOT NULL").select("h", "fp")).unionByName(classes.select("h", F.explode("bands").alias("key")))
    open_keys = persisted(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("star")).where("n > 1").select("key", "star"))
    pairs = persisted(keyed.join(open_keys, "key").select("star", "h").distinct())
    blocks = persisted(pairs.groupBy("star").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    members = persisted(pairs.join(blocks, "star").select("star", "h", "blocks", mine.alias("i")))
    wanted = members.select("h").distinct().join(classes.select("h", "first"), "h").select("h", F.col("first").alias("row"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(_words(t), shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["h", "shingles"])

    texts = rows.join(wanted, rows["row"].eqNullSafe(wanted["row"])).select("h", "text")
    sets = persisted(texts.mapInArrow(hashed, "h string, shingles array<bigint>").dropDuplicates(["h"]))
    every = lambda n: F.sequence(F.lit(0), n - 1)

    def compared(cells: DataFrame) -> DataFrame:
        """``star, a, b`` of the links within each cell ``star, i, j``; a member apart from the star is ``a`` without ``b``."""
        groups = cells.join(sets, "h").groupBy("star", "i", "j").agg(F.collect_list(F.struct("h", "shingles")).alias("members"))
        return persisted(groups.where("size(members) > 1").select("star", "members").mapInArrow(linked, "star string, a string, b string"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stars, a, b = [], [], []
            for star, group in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names = group.values.field("h").to_pylist()
                links = _jaccard_links([np.asarray(v.values, dtype=np.int64) for v in group.values.field("shingles")], similarity)
                root = list(range(len(names)))
                for x, y in links:
                    root[y] = x
                apart = [n for n, r in zip(names, root) if r != root[names.index(star)]] if star in names else []
                stars += [star] * (len(links) + len(apart))
                a += [names[x] for x, _ in links] + apart
                b += [names[y] for _, y in links] + [None] * len(apart)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (stars, a, b)], names=["star", "a", "b"])

    first = compared(members.select("star", "h", F.explode(F.when(F.col("h") == F.col("star"), every(F.col("blocks"))).otherwise(F.array("i"))).alias("i"), F.lit(0).alias("j")))
    # in a group of one block all have met
    apart = persisted(first.where("b IS NULL").select("star", F.col("a").alias("h")).join(members.where("blocks > 1"), ["star", "h"]).select("star", "h", "blocks"))
    links = first.where("b IS NOT NULL").select("a", "b")
    if not apart.isEmpty():
        parts = persisted(apart.groupBy("star").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
        alone = apart.join(parts, "star").select("star", "h", F.pmod(F.xxhash64("h", F.lit(1)), F.col("parts")).cast("int").alias("i"), F.explode(every(F.col("blocks"))).alias("j"))
        rest = members.join(parts, "star").select("star", "h", F.explode(every(F.col("parts"))).alias("i"), F.col("i").alias("j"))
        links = links.unionByName(compared(alone.unionByName(rest).distinct()).where("b IS NOT NULL").select("a", "b"))
    roots = connected_components(links)
    return classes.select("h", "first").join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "first", F.coalesce("root", "h").alias("root"))


def near_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = TEXT_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts, with its columns as they are.

    Texts are linked if their sets of ``shingle``-word runs have a Jaccard index of ``similarity`` or more; equal word
    sequences always are. The row with the smallest ``key`` stays (nulls last, then by a hash of the text), so rows
    with null or repeated ids are members like any other. At 0.8 fingerprints of 64 bits differ in some ten bits, which
    no segments can select, so what the fingerprints' deletion variants link is joined by bands of least hash values (found
    with a chance of ``1 - (1 - similarity**BAND_ROWS)**BANDS`` or more) and the verification of both is exact.
    """
    place = F.struct(docs[key].isNull().alias("none"), docs[key].alias("id"), F.md5(F.coalesce(docs[text], F.lit(""))).alias("digest"))
    rows = docs.withColumn("__row", place)
    parts = similar_components(rows, text=text, row="__row", shingle=shingle, similarity=similarity)
    mark = lambda at: F.concat_ws(":", F.col(f"{at}.digest"), F.col(f"{at}.id").cast("string"))
    first = parts.groupBy("root").agg(F.min("first").alias("first")).select(mark("first").alias("__mark"))
    marked = docs.withColumn("__row", place).select(*(docs[c] for c in docs.columns), mark("__row").alias("__mark"))
    kept = marked.join(first, "__mark", "left_semi")
    often = persisted(marked.groupBy("__mark").count().where("count > 1").select("__mark"))
    if often.isEmpty():
        return kept.select(*docs.columns)
    return kept.join(often, "__mark", "left_anti").unionByName(kept.join(often, "__mark", "left_semi").dropDuplicates(["__mark"])).select(*docs.columns)
