"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte context tree is counted over a sample of labelled texts. Statistics are then
frozen. A byte's code length under a language is that of the longest context of up to ``ORDER`` bytes that the tree
has; where the byte never followed it, an escape (method C: distinct followers / (occurrences + distinct followers))
is paid and the next shorter context is asked, down to eight bits for any byte. The language with the shortest code
for the whole text wins.

With frozen statistics a byte's code length depends on the last ``ORDER + 1`` bytes only, so the trees are turned into
lookup tables of window to code lengths. Training reads a bounded sample; scoring is one map without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = 4
#: Labelled documents that a language is learned from, on average at most: a sample by hash of the id, of whole texts.
SAMPLE_DOCS = 1500
#: Bytes of one language that are counted at once while learning.
BYTES_AT_ONCE = 4_000_000
UNKNOWN = "und"
#: Code lengths that are held at once while scoring.
NUMBERS_AT_ONCE = 4_000_000
_PAD = b"\n" * ORDER


def prepared(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def windows(raw: np.ndarray) -> np.ndarray:
    """Of each byte after the first ``ORDER``: it and those before it as one number, the byte itself lowest."""
    out = raw[ORDER:].astype(np.uint64)
    for back in range(1, ORDER + 1):
        out |= raw[ORDER - back : len(raw) - back].astype(np.uint64) << np.uint64(8 * back)
    return out


class Index:
    """Positions of 64-bit keys in a list of distinct ones: a hash table with linear probing, asked for many at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._slot(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        at = self._slot(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        open_ = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            out[open_] = self.slots[at[open_]]
            held = out[open_]
            open_ = open_[(held >= 0) & (self.keys[held] != keys[open_])]
        return out


@dataclass
class Level:
    """One context length: code lengths of the windows that any language has, and of the escapes from their contexts."""

    index: Index
    codes: np.ndarray
    contexts: Index
    escapes: np.ndarray


class Model:
    """Context trees of several languages, from the counts of their windows."""

    def __init__(self, languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language, distinct windows and how often each occurs."""
        self.languages = languages
        self.levels: list[Level] = []
        size = len(languages)
        for length in range(ORDER + 1):
            mask = np.uint64((1 << 8 * (length + 1)) - 1)
            own = []
            for keys, times in counts:
                distinct, where = np.unique(keys & mask, return_inverse=True)
                own.append((distinct, np.bincount(where, weights=times, minlength=len(distinct))))
            index = Index(np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.uint64))
            contexts = Index(np.unique(index.keys >> np.uint64(8)))
            escapes = np.zeros((len(contexts.keys), size))
            codes = np.tile(self.shorter(length, index.keys), 1) if size else np.zeros((0, 0))
            of_context = contexts.find(index.keys >> np.uint64(8))
            for k, (keys, times) in enumerate(own):
                context = contexts.find(keys >> np.uint64(8))
                total = np.bincount(context, weights=times, minlength=len(contexts.keys))
                followers = np.bincount(context, minlength=len(contexts.keys))
                seen = followers > 0
                escapes[seen, k] = np.log2((total[seen] + followers[seen]) / followers[seen])
                codes[:, k] += escapes[of_context, k]
                codes[index.find(keys), k] = np.log2((total + followers)[context] / times)
            self.levels.append(Level(index, codes, contexts, escapes))

    def shorter(self, length: int, keys: np.ndarray) -> np.ndarray:
        """Code lengths of windows under contexts of fewer than ``length`` bytes."""
        if length == 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        return self.code_lengths(keys & np.uint64((1 << 8 * length) - 1), length - 1)

    def code_lengths(self, keys: np.ndarray, length: int = ORDER) -> np.ndarray:
        """For each window its code length in bits under each language."""
        level = self.levels[length]
        at = level.index.find(keys)
        out = level.codes[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            keys = keys[missing]
            context = level.contexts.find(keys >> np.uint64(8))
            paid = level.escapes[context]
            paid[context < 0] = 0.0
            out[missing] = paid + self.shorter(length, keys)
        return out

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language, in blocks of bounded size."""
        size = max(1, len(self.languages))
        step = max(1024, NUMBERS_AT_ONCE // size)
        out = np.zeros((len(texts), len(self.languages)))
        raw = np.frombuffer(b"".join(_PAD + t for t in texts), dtype=np.uint8)
        ends = np.cumsum([len(t) + ORDER for t in texts])
        own = np.arange(len(raw)) - np.repeat(ends - [len(t) + ORDER for t in texts], [len(t) + ORDER for t in texts]) >= ORDER
        row = np.repeat(np.arange(len(texts)), [len(t) + ORDER for t in texts])
        for at in range(ORDER, len(raw), step):
            end = min(len(raw), at + step)
            lengths = self.code_lengths(windows(raw[at - ORDER : end]))
            lengths[~own[at:end]] = 0.0
            part = row[at:end]
            first = np.flatnonzero(np.diff(part, prepend=-1))
            out[part[first]] += np.add.reduceat(lengths, first, axis=0)
        return out


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a row is kept out of training: CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Counts the context trees of each language over its sample of the rows that are not held out.

    What reaches the driver are the distinct windows of ``sample_docs`` whole texts a language, however large the table.
    """
    labelled = docs.where(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    per_language = {r[0]: r[1] for r in labelled.groupBy(lang).count().orderBy(lang).collect()}
    if not per_language:
        return Model([], [])
    scale = 1 << 20
    share = F.create_map(*(F.lit(x) for lang_, n in per_language.items() for x in (lang_, min(scale, -(-sample_docs * scale // n)))))
    sampled = labelled.where(F.pmod(F.xxhash64(key), F.lit(scale)) < share[F.col(lang)]).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counts(name: str, bodies: list[bytes]) -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate([windows(np.frombuffer(b, dtype=np.uint8)) for b in bodies]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64))], names=["lang", "k", "n"])

        by: dict[str, list[bytes]] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = by.setdefault(name, [])
                held.append(_PAD + prepared(body))
                if sum(map(len, held)) > BYTES_AT_ONCE:
                    yield counts(name, by.pop(name))
        for name, bodies in by.items():
            yield counts(name, bodies)

    counted = sampled.mapInArrow(run, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    names, keys, times = (counted.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    languages = sorted(set(names))
    return Model(languages, [(keys[names == x].astype(np.uint64), times[names == x]) for x in languages])


def predict(docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, bits_per_byte`` of each row; only the text is looked at.

    ``score`` is the winner's share of the probability that the languages' codes give to the text. Null texts and
    texts without a letter, or a model without languages, give ``und`` and score 0. Of equal code lengths the
    alphabetically first language wins. Repeated rows are predicted each; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[key].cast("long").alias("doc_id"), held_out(key).alias("held_out"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            known = [i for i, t in enumerate(texts) if t and trees.languages and any(map(str.isalpha, t))]
            best, score, bits = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            while known:
                some, total = [], 0
                while known and total < NUMBERS_AT_ONCE // 4:
                    some.append(known.pop())
                    total += len(texts[some[-1]])
                raw = [prepared(texts[i]) for i in some]
                lengths = trees.totals(raw)
                least = lengths.argmin(axis=1)
                rest = np.exp2(np.maximum(lengths.min(axis=1, keepdims=True) - lengths, -1000)).sum(axis=1)
                for k, i in enumerate(some):
                    best[i], score[i], bits[i] = trees.languages[least[k]], float(1 / rest[k]), float(lengths[k, least[k]] / len(raw[k]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
