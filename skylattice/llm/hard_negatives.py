"""Hard negatives by product quantisation with residual norms, exact at the end.

1. Components become integers. A codebook with a list of integer centroids for every two components is fitted on a sample
   of at most ``SAMPLE`` rows, the ones of least hash; every row is then stored with its codes and, for each pair of
   components, the norm of what the centroid leaves over (rounded up).
2. Rows are dealt to blocks by hash, and anchors, the stated query set, are sent to every block. A task holds one block
   and meets anchors a few at a time. Sums from an anchor's lookup tables give each row's score up to the sum of products of
   the anchor's norms and the residual norms, so the score lies between two bounds. With these a row is left out only
   if enough others of its block are certainly better, or if its score is certainly outside the window.
3. Rows that remain get their exact integer score. Each block's best go on, and the best of all blocks are the result.

Positives are searched first, since their scores are the windows of the negatives. All arithmetic is on integers that
doubles hold exactly; vectors for which that is not so raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows that the codebook is fitted on, centroids of a pair of components, and rounds of fitting.
SAMPLE, CENTROIDS, ROUNDS = 4096, 256, 6
#: Rows of a block: as many as the smaller number at least, and at most about the larger one.
LEAST_BLOCK, BLOCK = 2048, 32_768
#: Anchors that meet a block together.
ANCHORS_AT_ONCE = 64
#: Scores and bounds are exact in doubles up to here.
EXACT = 1 << 52


def fitted(sample: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids ``(pairs, CENTROIDS, 2)`` of integer rows with an even number of components, by Lloyd's rounds from the first rows."""
    points = sample.reshape(len(sample), sample.shape[1] // 2, 2).transpose(1, 0, 2).astype(np.float64)
    out = np.zeros((len(points), CENTROIDS, 2))
    for own, book in zip(points, out):
        if len(own):
            book[:] = own[np.arange(CENTROIDS) % len(own)]
        for _ in range(rounds if len(own) > CENTROIDS else 0):
            near = _nearest(own, book)
            sums = np.stack([np.bincount(near, own[:, k], CENTROIDS) for k in (0, 1)], axis=1)
            size = np.bincount(near, minlength=CENTROIDS)
            book[size > 0] = sums[size > 0] / size[size > 0, None]
    return np.rint(out)


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(axis=1) - 2 * points @ book.T).argmin(axis=1)


def encoded(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the rows, and norms of the residuals, rounded up."""
    codes, norms = (np.empty((len(q), len(books)), kind) for kind in (np.uint8, np.int64))
    for m, book in enumerate(books):
        own = q[:, 2 * m : 2 * m + 2].astype(np.float64)
        codes[:, m] = _nearest(own, book)
        norms[:, m] = np.ceil(np.sqrt(((own - book[codes[:, m]]) ** 2).sum(axis=1)))
    return codes, norms


def bounds(anchors: np.ndarray, books: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest that the scores of ``anchors`` with encoded rows can be, one row for each anchor."""
    pairs = anchors.reshape(len(anchors), -1, 2).astype(np.float64)
    about = np.zeros((len(anchors), len(codes)))
    for m, book in enumerate(books):
        about += (pairs[:, m] @ book.T)[:, codes[:, m]]
    slack = np.ceil(np.sqrt((pairs**2).sum(axis=2))) @ norms.T
    return about - slack, about + slack


class _Block:
    """A block's rows; anchors ask it for their best."""

    def __init__(self, books: np.ndarray, rows: pa.Table, dim: int):
        self.books = books
        self.ids, self.labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        self.q = _matrix(rows.column("q"), dim)
        self.codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.norms = _matrix(rows.column("norms"), len(books)).astype(np.float64)

    def _best(self, anchor: np.ndarray, at: np.ndarray, lower: np.ndarray, upper: np.ndarray, low: float, high: float, n: int) -> list[tuple[int, int]]:
        """The first ``n`` of the rows ``at`` with a score from ``low`` to ``high``: ids and exact scores."""
        may = (upper >= low) & (lower <= high)
        sure = lower[(lower >= low) & (upper <= high)]
        if len(sure) > n:
            may &= upper >= np.partition(sure, len(sure) - n)[len(sure) - n]
        at = at[may]
        score = self.q[at] @ anchor
        inside = (score >= low) & (score <= high)
        at, score = at[inside], score[inside]
        first = np.lexsort((self.ids[at], -score))[:n]
        return list(zip(self.ids[at][first].tolist(), score[first].astype(np.int64).tolist()))

    def answer(self, anchors: pa.Table, dim: int, n: int, share: tuple[int, int] | None) -> Iterator[tuple]:
        q = _matrix(anchors.column("q"), dim)
        lower, upper = bounds(q, self.books, self.codes, self.norms)
        columns = (anchors.column(c).to_pylist() for c in ("row", "id", "label", "positives"))
        for k, (row, own, label, positives) in enumerate(zip(*columns, strict=True)):
            if share is None:
                at = np.flatnonzero((self.labels == label) & (self.ids != own))
                yield from ((row, None, None, None, *x) for x in self._best(q[k], at, lower[k, at], upper[k, at], -np.inf, np.inf, n))
                continue
            wanted = [(-(-share[0] * p["score"] // 100), share[1] * p["score"] // 100, p) for p in positives]
            wanted = [w for w in wanted if w[0] <= w[1]]
            if not wanted:
                continue
            least, most = min(w[0] for w in wanted), max(w[1] for w in wanted)
            at = np.flatnonzero((self.labels != label) & (upper[k] >= least) & (lower[k] <= most))
            for low, high, p in wanted:
                yield from ((row, p["rank"], p["id"], p["score"], *x) for x in self._best(q[k], at, lower[k, at], upper[k, at], low, high, n))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


ROWS = "block int, row long, id long, label long, q array<long>, codes binary, norms array<long>, positives array<struct<rank:int,id:long,score:long>>, asks boolean"
FOUND = pa.schema([("row", pa.int64()), ("rank", pa.int32()), ("positive", pa.int64()), ("positive_score", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _scan(rows: DataFrame, anchors: DataFrame, blocks: int, books: np.ndarray, dim: int, n: int, share: tuple[int, int] | None) -> DataFrame:
    """Every anchor against every block: rows ``row`` (of the anchor), the positive it is for, ``id, score``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block, waiting = None, [], None, []

        def ask() -> Iterator[pa.RecordBatch]:
            nonlocal block, held
            if waiting and block is None and held:
                block, held = _Block(books, pa.Table.from_batches(held), dim), []
            if waiting and block is not None:
                anchors = pa.Table.from_batches(waiting)
                for k in range(0, len(anchors), ANCHORS_AT_ONCE):
                    if found := list(block.answer(anchors.slice(k, ANCHORS_AT_ONCE), dim, n, share)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), FOUND)], schema=FOUND)
            waiting.clear()

        for batch in batches:
            at, asks = batch.column("block").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            # the batch is sorted by block, and in a block its rows come before anchors
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at[a] != number:
                    yield from ask()
                    number, held, block = at[a], [], None
                if asks[a]:
                    waiting.append(batch.slice(a, b - a))
                    if sum(x.num_rows for x in waiting) >= 16 * ANCHORS_AT_ONCE:
                        yield from ask()
                else:
                    held.append(batch.slice(a, b - a))
        yield from ask()

    none = F.array().cast("array<struct<rank:int,id:long,score:long>>")
    own = rows.withColumns({"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "positives": none, "asks": F.lit(False)})
    sent = anchors.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "codes": F.lit(None).cast("binary"), "norms": F.lit(None).cast("array<long>"), "asks": F.lit(True)})
    names = [c.split()[0] for c in ROWS.split(", ")]
    dealt = own.select(*names).unionByName(sent.select(*names)).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    return dealt.mapInArrow(run, "row long, rank int, positive long, positive_score long, id long, score long")


def quantised(vectors: DataFrame, *, key: str, vector: str, label: str, scale: int) -> tuple[DataFrame, np.ndarray, int]:
    """Rows ``row, id, label, q, codes, norms`` that take part, written once; the codebook; and the number of components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    given = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & F.col(key).isNotNull() & finite)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = given.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("q"))
    size, most = rows.agg(F.max(F.size("q")), F.max(F.array_max(F.transform("q", lambda x: F.abs(x.cast("double")))))).first()
    dim = (size or 0) + (size or 0) % 2 or 2
    if (most or 0) ** 2 * dim * 8 > EXACT:
        raise ValueError(f"components as large as {most} give scores that are not exact")
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("q"))))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("q").collect()
    books = fitted(np.array([r.q for r in sample], dtype=np.int64).reshape(-1, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, norms = encoded(_matrix(pa.chunked_array([batch.column("q")]), dim), books)
                residuals = pa.ListArray.from_arrays(pa.array(np.arange(0, norms.size + 1, norms.shape[1]), pa.int32()), pa.array(norms.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), residuals], names=["row", "id", "label", "q", "codes", "norms"])

    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "q")
    return stored(rows.mapInArrow(run, "row long, id long, label long, q array<long>, codes binary, norms array<long>")), books, dim


def _first(found: DataFrame, by: list[str], n: int) -> DataFrame:
    """The first ``n`` of each group, numbered; partial results of each task are cut to ``n`` before they move."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= n)


def hard_negatives(vectors: DataFrame, anchors: Column, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95), scale: int = 256) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``. An anchor (of ``id``, where the condition ``anchors`` holds) has as positives the first
    ``positives`` other rows of its label, by integer inner product, then id; for each of them it gets the first ``negatives``
    rows of other labels whose score is from ``share[0]`` to ``share[1]`` per cent of the positive's.
    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Vectors of different
    lengths are filled up with zeros. Rows that repeat an id are rows of their own, but not others of each other. Ties go
    to the smaller id. Anchors without positives, and positives without negatives, have no row; an empty table gives none;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    rows, books, dim = quantised(vectors, key=key, vector=vector, label=label, scale=scale)
    n = rows.count()
    blocks = max(-(-n // BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_BLOCK)), 1)
    none = F.array().cast("array<struct<rank:int,id:long,score:long>>")
    asking = rows.where(anchors).select("row", "id", "label", "q", none.alias("positives"))
    near = _first(_scan(rows, asking, blocks, books, dim, positives, None).select("row", "id", "score"), ["row"], positives)
    known = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("int").alias("rank"), "id", "score"))).alias("positives"))
    asking = stored(asking.drop("positives").join(known, "row").select("row", "id", "label", "q", "positives"))
    found = _first(_scan(rows, asking, blocks, books, dim, negatives, share), ["row", "rank"], negatives)
    named = found.withColumnRenamed("id", "negative_id").join(asking.select("row", F.col("id").alias("anchor_id")), "row")
    return named.select("anchor_id", F.col("positive").alias("positive_id"), F.col("at").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))
