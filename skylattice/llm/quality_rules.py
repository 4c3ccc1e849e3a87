"""Quality rules by tokeniser fertility.

How well a public vocabulary covers a text says much about it: ordinary prose needs few tokens for its characters, junk
needs many, binary rests fall back to bytes, and tables, decoration and stuttering have a token distribution of low
entropy. Each document is measured once, word by word: characters per token, share of byte tokens, token entropy.

The bands between which a text is accepted are learned from the table itself, for each language and script and, since
the entropy of a text grows with its length, for each half octave of its token count: the median and the quartiles of
the documents that pass the base rules, equal ones counted once. A text is rejected if it lies more than some standard
deviations (estimated from the quartiles) off the median. Groups of fewer than ``LEAST_DOCS`` documents use the bands of
their script in all languages, and where these are few too only the limits ``WIDEST`` hold.

Measuring is one map over Arrow batches, its memory bounded by a batch and a word cache of ``CACHE_WORDS`` entries. The
measures are written to the shared folder; learning and judging are DataFrame operations over a few numbers a document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, worker_cache

#: Words whose tokens a worker remembers; the cache starts anew when it is full.
CACHE_WORDS = 400_000
#: Tokens from which on all texts share a band: the entropy of a text levels off.
MOST_TOKENS = 4096
#: Documents from which bands are learned.
LEAST_DOCS = 30
#: Parts of a bin in the join of texts with their bands.
SALTS = 64
#: Standard deviations that a measure may be below and above the median, and the least deviation that is assumed.
FENCES = {"byte_share": (None, 5.0, 0.01), "chars_per_token": (5.0, 5.0, 0.03), "token_entropy": (3.5, None, 0.06)}
#: Limits where no band is known: characters per token, share of bytes at most, and entropy as a share of its greatest value.
WIDEST = {"chars_per_token": (0.3, 9.0), "byte_share": (None, 0.9), "token_entropy": (0.35, None)}
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)
NAMES = [x.split()[0] for x in MEASURES.split(", ")]


def repeated_words(words: list[bytes], seen: dict[bytes, int]) -> int:
    """Words in windows of eight that the text has twice or more.

    Windows are numbered exactly: pairs of words, then pairs of pairs, then pairs of those.
    """
    n = len(words)
    if n < WINDOW:
        return 0
    ids = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=n)
    for reach in (1, 2, 4):
        left, right = ids[:-reach], ids[reach:]
        _, ids = np.unique(left * (int(ids.max()) + 1) + right, return_inverse=True)
    starts = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(n + 1, dtype=np.int32)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edge) > 0))


def script_of(text: str) -> str:
    """The script that most letters of the text's own alphabet ranges belong to."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    latin = np.count_nonzero(((points >= 65) & (points <= 90)) | ((points >= 97) & (points <= 122)) | ((points >= 0xC0) & (points < 0x250)))
    cyrillic = np.count_nonzero((points >= 0x400) & (points < 0x530))
    cjk = np.count_nonzero(((points >= 0x3040) & (points < 0x3100)) | ((points >= 0x3400) & (points < 0xA000)) | ((points >= 0xAC00) & (points < 0xD7B0)))
    other = np.count_nonzero(points >= 0x250) - cyrillic - cjk
    return max((latin, "latin"), (cyrillic, "cyrillic"), (cjk, "cjk"), (other, "other"), key=lambda x: x[0])[1]


class WordTokens(dict):
    """Packed token ids of words under a SentencePiece vocabulary; misses of a document are encoded together."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])

    def of(self, counts: Counter) -> tuple[int, float, float]:
        """Tokens, share of byte tokens, and entropy in bits of the words in ``counts``."""
        if len(self) > CACHE_WORDS:
            self.clear()
        if missing := [w for w in counts if w not in self]:
            for word, ids in zip(missing, self.pieces.encode([w.decode("utf-8") for w in missing], num_threads=1), strict=True):
                self[word] = np.array(ids, dtype=np.int32).tobytes()
        each = [self[w] for w in counts]
        weights = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), np.fromiter(map(len, each), np.int64, len(each)) // 4)
        ids = np.frombuffer(b"".join(each), dtype=np.int32)
        total = int(weights.sum())
        if not total:
            return 0, 0.0, 0.0
        sums = np.bincount(np.unique(ids, return_inverse=True)[1], weights=weights)
        share = sums / total
        return total, float(weights[self.is_byte[ids]].sum() / total), float(-(share * np.log2(share)).sum())


def measure(text: str | None, tokens: WordTokens) -> tuple:
    """The columns of ``MEASURES`` for one text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    counts = Counter(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_repeat = repeated_words(words, {w: i for i, w in enumerate(counts)})
    base_failed = len(words) < 20 or 100 * n_repeat > 30 * len(words)
    n_tokens, byte_share, entropy = tokens.of(counts)
    per_token = word_chars / n_tokens if n_tokens else 0.0
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, base_failed, script_of(text), n_tokens, per_token, byte_share, entropy


def measured(docs: DataFrame, model_file: str, *, text: str = "text", lang: str | None = "lang", carry: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``carry`` columns, ``{prefix}lang`` (empty if null or not there) and the columns of ``MEASURES`` under ``prefix``."""
    own = F.coalesce(docs[lang].cast("string"), F.lit("")) if lang is not None and lang in docs.columns else F.lit("")
    rows = docs.select(*(docs[c] for c in carry), docs[text].alias(f"{prefix}text"), own.alias(f"{prefix}lang"))
    n = len(carry)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n]) + "".join(f", {prefix}{x}" for x in ("lang string", *MEASURES.split(", ")))
    names = [*carry, *(prefix + x for x in ("lang", *NAMES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_cache(f"tokens {model_file}", lambda: WordTokens(model_file))
        for batch in batches:
            if batch.num_rows:
                each = [measure(t, tokens) for t in batch.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], batch.column(n + 1), *(pa.array(list(c)) for c in zip(*each, strict=True))], names=names)

    return rows.mapInArrow(run, schema)


def size_bin(n_tokens: Column) -> Column:
    """Half octaves of the token count, the last without an upper end."""
    return F.floor(2 * F.log2(F.greatest(F.lit(1), F.least(n_tokens, F.lit(MOST_TOKENS))))).cast("int")


def learned_bands(measures: DataFrame, by: list[str], *, prefix: str = "", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``by`` columns, ``n_docs``, and ``low_`` and ``high_`` limits of each measure, from ``measures`` with a ``bin``."""
    p = prefix
    distinct = measures.where(~F.col(f"{p}base_failed")).select(*by, f"{p}n_words", f"{p}word_chars", f"{p}n_tokens", *(f"{p}{m}" for m in FENCES)).distinct()
    quartiles = distinct.groupBy(*by).agg(F.count("*").alias("n_docs"), *(F.percentile_approx(f"{p}{m}", [0.25, 0.5, 0.75], 10_000).alias(m) for m in FENCES)).where(F.col("n_docs") >= least_docs)
    limits = []
    for m, (below, above, least) in FENCES.items():
        sigma = F.greatest((F.col(m)[2] - F.col(m)[0]) / 1.349, F.lit(least))
        limits += [(F.col(m)[1] + sign * k * sigma).alias(f"{side}_{m}") for side, sign, k in (("low", -1, below), ("high", 1, above)) if k is not None]
    return quartiles.select(*by, "n_docs", *limits)


def judged(measures: DataFrame, *, prefix: str = "", least_docs: int = LEAST_DOCS) -> DataFrame:
    """``measures`` and ``{prefix}rejected_by``: ``base``, the name of the first measure that is out of its band, or null."""
    p = prefix
    binned = measures.withColumn(f"{p}bin", size_bin(F.col(f"{p}n_tokens")))
    # a language's texts are in a few bins: both sides are spread over salts, so that no task gets a whole bin
    own = learned_bands(binned, [f"{p}lang", f"{p}script", f"{p}bin"], prefix=p, least_docs=least_docs)
    own = own.select(*own.columns[:3], *(F.col(c).alias(f"{p}own_{c}") for c in own.columns[3:]), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{p}salt"))
    salt = F.pmod(F.xxhash64(f"{p}n_words", f"{p}word_chars", f"{p}token_entropy"), F.lit(SALTS)).cast("int")
    out = binned.withColumn(f"{p}salt", salt).join(own, [f"{p}lang", f"{p}script", f"{p}bin", f"{p}salt"], "left")
    # four scripts by 25 bins at most
    every = learned_bands(binned, [f"{p}script", f"{p}bin"], prefix=p, least_docs=least_docs)
    every = every.select(*every.columns[:2], *(F.col(c).alias(f"{p}all_{c}") for c in every.columns[2:]))
    out, known = out.join(F.broadcast(every), [f"{p}script", f"{p}bin"], "left"), [f"{p}own", f"{p}all"]

    def limit(side: str, m: str) -> Column:
        widest = F.lit(WIDEST[m][side == "high"]) * (F.log2(F.least(F.col(f"{p}n_tokens"), F.lit(MOST_TOKENS)) + 1) if m == "token_entropy" else 1)
        return F.coalesce(*(F.col(f"{k}_{side}_{m}") for k in known), widest)

    why = F.when(F.col(f"{p}base_failed"), "base")
    for m, (below, above, _) in FENCES.items():
        for wrong in [F.col(f"{p}{m}") < limit("low", m)] * (below is not None) + [F.col(f"{p}{m}") > limit("high", m)] * (above is not None):
            why = why.when(wrong, m)
    return out.select(*measures.columns, why.alias(f"{p}rejected_by"))


def quality_measures(docs: DataFrame, model_file: str, *, text: str = "text", lang: str | None = "lang", carry: tuple[str, ...] = ("doc_id",), least_docs: int = LEAST_DOCS) -> DataFrame:
    """``carry`` columns, the columns of ``MEASURES``, ``kept`` and ``rejected_by`` for each row of ``docs``.

    Null and empty texts have no words, fail the base rules and are not kept. A null language falls back to the bands of
    the text's script in all languages. Repeated rows are measured each but count once for the bands; an empty table
    gives no rows; columns outside ``carry`` are ignored, and ``carry`` must not name a measure.
    """
    each = judged(stored(measured(docs, model_file, text=text, lang=lang, carry=carry, prefix="__q_")), prefix="__q_", least_docs=least_docs)
    return each.select(*carry, *(F.col(f"__q_{m}").alias(m) for m in NAMES), F.col("__q_rejected_by").isNull().alias("kept"), F.col("__q_rejected_by").alias("rejected_by"))


def quality_filter(docs: DataFrame, model_file: str, *, text: str = "text", lang: str | None = "lang", least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are; see ``quality_measures`` for the cases.

    Texts are measured once: the rows are written with their measures, from which the bands are learned.
    """
    each = judged(stored(measured(docs, model_file, text=text, lang=lang, carry=tuple(docs.columns), prefix="__q_")), prefix="__q_", least_docs=least_docs)
    return each.where("__q_rejected_by IS NULL").select(*docs.columns)
