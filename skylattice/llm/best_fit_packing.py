"""Packing documents into sequences of a fixed number of tokens: best-two-fit.

A bin is filled greedily with the longest document that still fits, until none does. If a gap is left,
the bin's smallest document is replaced by the two unpacked documents that fit into the expanded gap
most tightly, as long as that makes the gap smaller.

Documents are tokenised in one map; only a few numbers a piece are shuffled, dealt out by a hash so that
no key is hot. Each task packs its rows in chunks of bounded size, so memory does not depend on the input.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: Words whose ids a worker remembers; the cache starts anew when it is full.
CACHE_WORDS = 1_000_000
#: Pieces that are packed together: dealt to a task on average, and held by a task at most.
PIECES_PER_TASK = 32_768
PIECES_AT_ONCE = 131_072
#: Bytes of pieces that a task holds, which counts if they carry their ids.
BYTES_AT_ONCE = 192 << 20
#: Tasks at most: beyond that each packs several chunks.
MOST_TASKS = 65_536
END_OF_TEXT = 1


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to ``capacity``); bins are numbered from 0 and have no holes.

    Unpacked lengths are the one bits of a number, so that the longest that fits and the best pair of two are
    found by shifting and masking it; ``mirror`` has them in opposite order.
    """
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        waiting.setdefault(n, []).append(i)
    present = sum(1 << n for n in waiting)
    mirror = sum(1 << (capacity - n) for n in waiting)
    below = [(2 << n) - 1 for n in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal present, mirror
        i = waiting[n].pop()
        if not waiting[n]:
            present ^= 1 << n
            mirror ^= 1 << (capacity - n)
        return i

    def put_back(n: int, i: int) -> None:
        nonlocal present, mirror
        if not waiting[n]:
            present |= 1 << n
            mirror |= 1 << (capacity - n)
        waiting[n].append(i)

    def best_pair(least: int, most: int) -> tuple[int, int] | None:
        for total in range(most, least, -1):
            pairs = present & below[total - 1] & (mirror >> (capacity - total))
            while pairs:
                n = pairs.bit_length() - 1
                if 2 * n != total or len(waiting[n]) > 1:
                    return n, total - n
                pairs ^= 1 << n
        return None

    number = 0
    while present:
        gap, chosen = capacity, []
        while fitting := present & below[gap]:
            n = fitting.bit_length() - 1
            chosen.append((n, take(n)))
            gap -= n
        while gap and present:
            smallest = min(range(len(chosen)), key=lambda k: chosen[k][0])
            n, i = chosen[smallest]
            if (pair := best_pair(n, n + gap)) is None:
                break
            gap += n - sum(pair)
            chosen[smallest : smallest + 1] = [(x, take(x)) for x in pair]
            put_back(n, i)
        at = 0
        for n, i in chosen:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


class WordIds(dict):
    """Packed ids of words, for vocabularies whose tokens end with words and know no case and no white space.

    There a text's ids are its words' ids. Texts are encoded whole under any other vocabulary.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        parts = json.loads(self.tokenizer.to_str())
        self.by_words = bool(parts["model"].get("end_of_word_suffix")) and '"Lowercase"' in json.dumps(parts.get("normalizer"))

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHE_WORDS:
            self.clear()
        text = word.decode("utf-8")
        # letters and a final stop or comma are separate before the merges
        packed = self[word[:-1]] + self[word[-1:]] if word[-1] in b".," and text[:-1].lower().isalpha() else self.ids(text)
        self[word] = packed
        return packed

    def of(self, text: str) -> bytes:
        low = text.encode("utf-8", "replace").lower()
        if not self.by_words or any(token in low for token in self.special):  # special tokens are matched before letters are lowered
            return self.ids(text)
        return b"".join(map(self.__getitem__, low.split()))


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (packed, binary)."""
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    end = np.array([END_OF_TEXT], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_cache(f"ids {tokenizer_file}", lambda: WordIds(tokenizer_file))
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = (words.of(body) if body else b"") + end
                for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds)], names=NAMES[: len(out[0])])

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]


def pack_documents(
    docs: DataFrame, tokenizer_file: str, *, capacity: int = 4096, key: str = "doc_id", text: str = "text", with_ids: bool = False, pieces_per_task: int = PIECES_PER_TASK
) -> DataFrame:
    """Packs every row of ``docs`` into sequences of at most ``capacity`` tokens.

    A document is the ids of its text and one closing id; only longer ones are cut, into pieces of ``capacity`` tokens
    (the last may be shorter). Returns a row a piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id,
    offset``. Null and empty texts become one closing id. Repeated rows are packed separately; an empty table gives no
    rows; other columns are ignored. With ids, up to ``BYTES_AT_ONCE`` bytes of pieces are packed together.
    """
    pieces = token_pieces(docs, tokenizer_file, capacity, key=key, text=text, with_ids=with_ids)
    tasks = max(1, min(MOST_TASKS, -(-docs.count() // pieces_per_task)))
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartition(tasks, spread).sortWithinPartitions(spread, "doc_id", "piece", "ids_crc32")
    names = NAMES[: 5 + with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first
            table = pa.Table.from_batches(held)
            held.clear()
            bins, offsets = best_two_fit(table.column("length").to_numpy(), capacity)
            done = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
            first += int(bins.max()) + 1
            yield from done.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= PIECES_AT_ONCE or sum(b.nbytes for b in held) >= BYTES_AT_ONCE:
                yield from packed()
        if held:
            yield from packed()

    schema = ", ".join(f"{n} {dealt.schema[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)
