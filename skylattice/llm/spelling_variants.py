"""Spelling variants by a symmetric-delete join.

1. Words are counted document by document in Arrow batches, and summed in Spark.
2. Every word emits itself and its distinct single deletions as keys; words that share a key are joined. They are near
   if exactly one code point was inserted, deleted or replaced between them, which is verified.
3. Of a word's near words the most frequent is its form, if it is frequent enough.
4. Words follow forms to the last one, the root: each round joins every word with the form of its present one and so
   doubles the steps. A form is more frequent than its word, so there are no circles and few rounds.

Near words share one key exactly, so no pair comes twice. If lengths differ by one, a key of both can only be the
shorter word itself. If they are equal, let them differ at position p: where both without some code point are the same
string, the first lacks its own code point of p and the second lacks its own (their letters are otherwise the same), and
each deletion then gives what deleting at p gives. A key's words differ from it by one inserted code point, so their number
has a bound that does not grow with the table: the alphabet's size by the places of a word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persisted, stored

WORD = re.compile("[A-Za-zÀ-ÿ]+")
#: Code points of a text that are looked at together (more where a word goes on), and counts that a task holds.
CHUNK, HELD = 1 << 20, 200_000
#: One in so many pairs of a document and a word has a letter missing.
MISSING = 97


def lowered(word: str) -> str:
    """A-Z in lower case, and nothing else."""
    return word.lower() if word.isascii() else "".join(c.lower() if c.isascii() else c for c in word)


def counted(text: str) -> Counter[str]:
    """The words of a whole text, lower-cased, with their numbers."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            end = WORD.match(text, end).end() if WORD.match(text, end) else end
        found.update(WORD.findall(text, at, end))
        at = end
    out: Counter[str] = Counter()
    for word, n in found.items():
        out[lowered(word)] += n
    return out


def misspelt(doc: int | None, word: str, one_in: int) -> str:
    """The word without one letter, in the documents that a checksum selects."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    if doc is None or h % one_in:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, *, key: str, text: str, least_length: int, least_count: int, missing: int | None) -> DataFrame:
    """``word, n`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, body in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                for word, n in counted(body.as_py() or "").items():
                    if missing:
                        word = misspelt(doc, word, missing)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keys(word: str) -> Column:
    """A word and its distinct deletions."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_append(F.array_distinct(without), F.col(word))


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n`` of all words that are near each other, both ways and each pair once.

    The join sorts: a word becomes as many keys as it has places, so the size of the stored words says little about theirs,
    and a broadcast that is planned by it goes through the driver.
    """
    keys = words.select("word", "n", F.explode(_keys("word")).alias("key"))
    others = keys.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = keys.join(others.hint("merge"), "key").where("word <> other")
    one = F.when(F.length("word") == F.length("other"), F.levenshtein("word", "other", 1) == 1).otherwise(F.abs(F.length("word") - F.length("other")) == 1)
    return pairs.where(one).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the rows ``word, form``: the last form that following forms leads to."""
    at = persisted(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = persisted(at.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if joined.where("moved").isEmpty():
            return at
        at = joined.drop("moved")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, ratio: int = 2, missing: int | None = None) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the texts.

    A word is a maximal run of Latin letters with A-Z in lower case, of at least ``least_length`` code points and at least
    ``least_count`` occurrences ``n``. ``form`` is the near word of the largest n, the first in code-point order of equals, if that
    is at least ``ratio`` (over 1) times the word's; otherwise form and ``form_n`` are null. ``root`` is where forms lead.
    With ``missing`` one in so many pairs of a document and a word lacks a letter, selected by a checksum of id and word,
    which serves to measure how many variants are found; rows with a null id are left as they are then.
    Null and empty texts have no words, and texts may be as long as a row can be; repeated rows count again; an empty table
    gives no rows; other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = stored(word_counts(docs, key=key, text=text, least_length=least_length, least_count=least_count, missing=missing))
    best = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best"))
    enough = -F.col("best.n") >= ratio * F.col("n")
    near = stored(best.select("word", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")))
    ends = roots(near.where("form IS NOT NULL"))
    return words.join(near.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
