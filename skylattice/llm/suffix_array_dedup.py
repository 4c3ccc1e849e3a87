"""Repeated passages by sparse suffix arrays.

A passage counts as repeated if a window of ``LENGTH`` words in it occurs somewhere else too. Suffixes are retained at
content-selected positions only: the minimiser of a window is the position of its least ``ANCHOR``-word hash, the
leftmost of equals, so equal windows select the same word. Two places have a window in common exactly if their
suffixes at its minimiser agree in its words from there on and, extended to the left, in its words before it.

1. Anchors (the first ``ANCHOR`` words of retained suffixes) of all documents are counted; only those that occur twice
   or more go on.
2. Each remaining suffix is written with the words of its *stretch*, all windows that select it (once a task).
3. Suffixes are sorted, those with one anchor together, and neighbours are compared word by word, to the right and to
   the left, which gives the windows that they share. Anchors with very many suffixes, as in a passage that is in a
   third of all documents, are not for one task: equal stretches collapse on the map side, and the rest is compared
   window by window in a grouped aggregation under 128-bit digests. Both give the same.
4. What was found goes back to the documents, of which the smallest (id, position) of each window is the first.

Stretches are told apart by 128 bits (anchor and stretch); the shorter hashes of step 1 only choose candidates.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, worker_cache

LENGTH, ANCHOR = 50, 8
#: Words whose hashes a worker remembers; the cache starts anew when it is full.
CACHE_WORDS = 500_000
#: Suffixes of one anchor that a task compares, and rows that it compares at once.
SUFFIXES = 20_000
ROWS_AT_ONCE = 20_000
#: Stretches that a task remembers having written with their words; it starts anew after that.
SEEN = 100_000
#: Stands for a null id, after all others.
NO_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


class Hashes:
    """Hashes of any runs of a document's words."""

    def __init__(self, words: list[bytes], known: WordHashes):
        n = len(words)
        own = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.add.accumulate(own * _powers(_BASE, n), out=self.sums[1:])
        self.down = _powers(_INVERSE, n)

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        first = self.down[start] if isinstance(start, np.ndarray) else self.down[: len(self.sums[end])]
        return _mixed((self.sums[end] - self.sums[start][: len(first)]) * first)

    def runs(self, length: int) -> np.ndarray:
        return self.of(slice(0, len(self.sums) - length), slice(length, None))


def minimisers(hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash of every position, and for each window the position of its minimiser."""
    anchors = hashes.runs(ANCHOR)
    span = LENGTH - ANCHOR + 1
    view = np.lib.stride_tricks.sliding_window_view(anchors, span)
    return anchors, view.argmin(axis=1) + np.arange(len(view))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = worker_cache("word hashes", WordHashes)
    for batch in batches:
        rows, found, often = [], [], []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = word_list(text)
            if len(words) >= LENGTH:
                anchors, chosen = minimisers(Hashes(words, known))
                own, times = np.unique(anchors[np.unique(chosen)], return_counts=True)
                found.append(own)
                often.append(times.astype(np.int32))
                rows.append(np.full(len(own), row, dtype=np.int64))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(often))], names=["row", "anchor", "n"])


SUFFIX = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()), ("stretch", pa.int64()), ("crowded", pa.bool_()), ("before", pa.int32()), ("words", pa.string())])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The retained suffixes of each text whose anchor is wanted, with as many words on both sides as its windows have.

    A stretch has its words where the task meets it first only.
    """
    known = worker_cache("word hashes", WordHashes)
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        columns: list[list] = [[] for _ in SUFFIX]
        for doc, tag, text, wanted, crowded in zip(*(batch.column(c).to_pylist() for c in ("id", "tag", "text")), batch.column("wanted"), batch.column("crowded"), strict=True):
            words = word_list(text)
            if len(words) < LENGTH:
                continue
            hashes = Hashes(words, known)
            anchors, chosen = minimisers(hashes)
            first = np.flatnonzero(np.diff(chosen, prepend=-1))
            last = np.append(first[1:], len(chosen))
            own = anchors[chosen[first]].view(np.int64)
            keep = np.isin(own, np.asarray(wanted.values, dtype=np.int64))
            first, last, own = first[keep], last[keep], own[keep]
            whole = (hashes.of(first, last + LENGTH - 1) ^ (last - first).astype(np.uint64)).view(np.int64)
            around: list[str | None] = []
            for a, b, key in zip(first.tolist(), (last + LENGTH - 1).tolist(), zip(own.tolist(), whole.tolist())):
                around.append(None if key in seen else b" ".join(words[a:b]).decode("utf-8"))
                seen.add(key)
            if len(seen) > SEEN:
                seen.clear()
            many = np.isin(own, np.asarray(crowded.values, dtype=np.int64))
            for column, values in zip(columns, ([doc] * len(first), [tag] * len(first), first, own, whole, many, chosen[first] - first, around), strict=True):
                column.extend(values)
        if columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SUFFIX)], schema=SUFFIX)


def _sorted(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words (-1: none), and of each row but the first the words it shares with the one before."""
    order = np.lexsort(words.T[::-1])
    ranked = words[order]
    same = (ranked[1:] == ranked[:-1]) & (ranked[1:] >= 0)
    return order, np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _classes(order: np.ndarray, shared: np.ndarray, least: int) -> np.ndarray:
    """Numbers of the rows' classes: sorted neighbours that share ``least`` words are in one."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(shared < least)])
    return out


def _merged(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """Rows of equal stretches as one: a row with the words, the first, and the last."""
    anchor, stretch, doc, tag, start = (rows.column(c).to_numpy() for c in ("anchor", "stretch", "id", "tag", "start"))
    order = np.lexsort((start, tag, doc, stretch, anchor))
    heads = np.flatnonzero((np.diff(anchor[order], prepend=anchor[order[0]]) != 0) | (np.diff(stretch[order], prepend=stretch[order[0]]) != 0) | (np.arange(len(order)) == 0))
    written = rows.column("words").is_valid().to_numpy()[order]
    at = np.minimum.reduceat(np.where(written, np.arange(len(order)), len(order)), heads)
    return order[at], order[heads], order[np.append(heads[1:], len(order)) - 1]


def _compare(rows: pa.Table) -> pa.RecordBatch:
    """Bits of each stretch's windows that occur elsewhere, and of those whose first place is the stretch's own.

    Suffixes are sorted by the words from the anchor on, and once more by the words before it, read leftwards. Where
    neighbours share ``50 - j`` words to the right and ``j`` to the left they have the window that begins ``j`` words
    before the anchor in common; classes of neighbours make that hold for any two rows, word by word.
    """
    whole, low, high = _merged(rows)
    low_id, low_tag, low_at = (rows.column(c).to_numpy()[low] for c in ("id", "tag", "start"))
    high_id, high_tag, high_at = (rows.column(c).to_numpy()[high] for c in ("id", "tag", "start"))
    anchor, stretch = (rows.column(c).to_numpy()[low] for c in ("anchor", "stretch"))
    rows = rows.select(["before", "words"]).take(pa.array(whole))
    before = rows.column("before").to_numpy()
    number: dict[bytes, int] = {}
    numbers, sizes = array("i"), np.empty(len(before), np.int64)
    for i, text in enumerate(rows.column("words")):
        words = text.as_py().encode("utf-8").split()
        sizes[i] = len(words)
        numbers.extend([number.setdefault(w, len(number)) for w in words])
    del number
    flat = np.frombuffer(numbers, dtype=np.int32)
    begins = np.cumsum(sizes) - sizes
    right, left = np.full((len(sizes), LENGTH), -1, np.int32), np.full((len(sizes), LENGTH - ANCHOR), -1, np.int32)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - begins[row] - before[row]
    inside = (at >= 0) & (at < LENGTH)
    right[row[inside], at[inside]] = flat[inside]
    inside = at < 0
    left[row[inside], -1 - at[inside]] = flat[inside]
    by_right, by_left = _sorted(right), _sorted(left)

    multiple = (low_id != high_id) | (low_tag != high_tag) | (low_at != high_at)
    docs = np.lexsort((low_tag, low_id))
    rank = np.empty(len(docs), np.int64)
    rank[docs] = np.concatenate([[0], np.cumsum((np.diff(low_id[docs]) != 0) | (np.diff(low_tag[docs]) != 0))])
    repeated, first = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
    for j in range(LENGTH - ANCHOR + 1):
        has = np.flatnonzero((before >= j) & (before - j <= sizes - LENGTH))
        if not len(has):
            continue
        group = _classes(*by_right, LENGTH - j)[has] * len(sizes) + _classes(*by_left, j)[has]
        place = rank[has] << 32 | (low_at[has] + before[has] - j)
        order = np.lexsort((place, group))
        head = np.diff(group[order], prepend=-1) != 0
        which = np.empty(len(has), np.int64)
        which[order] = np.cumsum(head) - 1
        often = (np.bincount(which) > 1) | (np.bincount(which, weights=multiple[has]) > 0)
        bit = np.left_shift(np.uint64(1), (before[has] - j).astype(np.uint64))
        repeated[has] |= np.where(often[which], bit, np.uint64(0))
        first[has] |= np.where(place == place[order[head]][which], bit, np.uint64(0))
    columns = (anchor, stretch, low_id, low_tag, low_at, repeated.view(np.int64), first.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "stretch", "low_id", "low_tag", "low_at", "repeated", "first"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares sorted stretches in blocks that end where the anchor changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield _compare(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
    if held:
        yield _compare(pa.Table.from_batches(held))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every stretch under its 128-bit digest."""
    for batch in batches:
        for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            row, at, window = [], [], []
            for i, text in enumerate(part.column("words").to_pylist()):
                words = text.encode("utf-8").split()
                for k in range(len(words) - LENGTH + 1):
                    row.append(i)
                    at.append(k)
                    window.append(xxhash.xxh3_128_digest(b" ".join(words[k : k + LENGTH])))
            taken = part.drop_columns(["words"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(at, pa.int32()), pa.array(window, pa.binary())], names=[*taken.schema.names, "at", "window"])


def _compare_windows(stretches: DataFrame) -> DataFrame:
    """The same as ``_compare`` for any number of stretches, as joins and aggregations over single windows."""
    keys = "anchor long, stretch long, low_id long, low_tag long, low_at int, high_id long, high_tag long, high_at int"
    names = [k.split()[0] for k in keys.split(", ")]
    each = stretches.select(*names, "words").mapInArrow(_windows, f"{keys}, at int, window binary")
    place = {k: F.struct(F.col(f"{k}_id").alias("id"), F.col(f"{k}_tag").alias("tag"), (F.col(f"{k}_at") + F.col("at")).alias("at")) for k in ("low", "high")}
    each = each.withColumns(place)
    seen = each.groupBy("window").agg(F.min("low").alias("least"), F.max("high").alias("most"))
    both = each.join(seen, "window")
    bit, none = F.expr("shiftleft(1L, at)"), F.lit(0).cast("long")
    repeated = F.bit_or(F.when(F.col("least") != F.col("most"), bit).otherwise(none))
    first = F.bit_or(F.when(F.col("low") == F.col("least"), bit).otherwise(none))
    return both.groupBy("anchor", "stretch", "low_id", "low_tag", "low_at").agg(repeated.alias("repeated"), first.alias("first"))


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def spans(starts: np.ndarray) -> list[tuple[int, int]]:
        starts = np.sort(starts)
        if not len(starts):
            return []
        new = np.flatnonzero(np.diff(starts, prepend=-LENGTH - 1) > LENGTH)
        return list(zip(starts[new].tolist(), (starts[np.append(new[1:], len(starts)) - 1] + LENGTH).tolist()))

    for batch in batches:
        ids, found = [], []
        for doc, tag, items in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            starts, repeated, later = (np.array([x[k] for x in items], dtype=np.int64) for k in ("start", "repeated", "later"))
            places = {}
            for name, bits in (("repeated", repeated), ("later", later)):
                set_ = (bits.view(np.uint64)[:, None] >> np.arange(LENGTH, dtype=np.uint64)) & np.uint64(1)
                which, at = np.nonzero(set_)
                places[name] = spans(np.unique(starts[which] + at))
            for start, end in places["repeated"]:
                cut = [(a, b) for a, b in places["later"] if start <= a < end]
                ids.append((doc, tag))
                found.append({"start": start, "end": end, "cut": [{"start": a, "end": b} for a, b in cut]})
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        if ids:
            columns = [*zip(*ids), *([x[k] for x in found] for k in ("start", "end", "cut"))]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), kind)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["id", "tag", "start", "end", "cut"])


def repeated_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", suffixes_per_anchor: int = SUFFIXES) -> DataFrame:
    """``doc_id, tag, start, end, cut`` of each maximal run of words that repeated windows cover, in words from 0, end exclusive.

    ``cut`` lists the runs within it that are no first occurrence; the first is that of the smallest id, nulls last.
    Rows that share id and text are one document: words at one place of it are one occurrence, and it is reported
    once. Rows that share an id but not the text are documents of their own, told apart by ``tag``, a hash of the text.
    Null and empty texts and texts under fifty words have no passages; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(docs[text]).alias("tag"), docs[text].alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "tag"))
    anchors = stored(rows.select("row", "text").mapInArrow(_anchors, "row long, anchor long, n int"))
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", (F.col("n") > suffixes_per_anchor).alias("many"))
    wanted = anchors.join(often, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("wanted"), F.collect_set(F.when(F.col("many"), F.col("anchor"))).alias("crowded"))
    suffix = "id long, tag long, start int, anchor long, stretch long, crowded boolean, before int, words string"
    found = stored(rows.join(wanted, "row").select("id", "tag", "text", "wanted", "crowded").mapInArrow(_suffixes, suffix))

    schema = "anchor long, stretch long, low_id long, low_tag long, low_at int, repeated long, first long"
    few = found.where("NOT crowded").select("anchor", "stretch", "id", "tag", "start", "before", "words")
    usual = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_neighbours, schema)
    place = F.struct("id", "tag", "start")
    distinct = found.where("crowded").groupBy("anchor", "stretch").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.any_value("words", True).alias("words"))
    sides = [f"{side}.{a} AS {side}_{b}" for side in ("low", "high") for a, b in (("id", "id"), ("tag", "tag"), ("start", "at"))]
    marks = usual.unionByName(_compare_windows(distinct.selectExpr("anchor", "stretch", *sides, "words"))).where("repeated <> 0")

    own = (F.col("id") == F.col("low_id")) & (F.col("tag") == F.col("low_tag")) & (F.col("start") == F.col("low_at"))
    later = F.when(own, F.expr("repeated & ~first")).otherwise(F.col("repeated"))
    marked = found.select("id", "tag", "start", "anchor", "stretch").join(marks, ["anchor", "stretch"])
    items = marked.select("id", "tag", F.struct("start", "repeated", later.alias("later")).alias("item")).groupBy("id", "tag").agg(F.collect_set("item").alias("items"))
    passages = items.mapInArrow(_passages, "id long, tag long, start int, end int, cut array<struct<start:int,end:int>>")
    return passages.select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "tag", "start", "end", "cut")


def _without(text: str, cuts: list[tuple[int, int]]) -> str:
    """``text`` without some runs of words and the white space after them."""
    raw = text.encode("utf-8", "replace")
    space = np.isin(np.frombuffer(raw, dtype=np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))
    begins = np.append(np.flatnonzero(~space & np.concatenate([[True], space[:-1]])), len(raw))
    out, at = [], 0
    for start, end in sorted(cuts):
        out.append(raw[at : begins[start]])
        at = begins[min(end, len(begins) - 1)]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def suffix_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with later occurrences of repeated passages cut out of ``text``; ``length`` (if there) follows.

    The first occurrence of every passage stays, and so do all rows, even if nothing of their text is left: null ids
    and null texts too. Cuts are those of the row's own id and text, so rows that repeat an id with another text are
    not touched by them; rows that repeat both are cut alike. An empty table stays empty; other columns are as they were.
    """
    passages = repeated_passages(docs, key=key, text=text)
    cuts = passages.where("size(cut) > 0").groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("tag").alias("__tag")).agg(F.flatten(F.collect_list("cut")).alias("__cuts"))
    keyed = docs.withColumns({"__id": F.coalesce(docs[key].cast("long"), F.lit(NO_ID)), "__tag": F.xxhash64(docs[text])})
    joined = keyed.join(cuts, ["__id", "__tag"], "left").select(*docs.columns, "__cuts")
    names = docs.columns
    where, counted = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where).to_pylist()
            new = [t if t is None or not c else _without(t, [(x["start"], x["end"]) for x in c]) for t, c in zip(texts, batch.column(len(names)).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[where] = pa.array(new, pa.string())
            if counted is not None:
                columns[counted] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[counted].to_pylist(), texts, new, strict=True)], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
