"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies; it is read there and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_measures

    return quality_measures(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_viterbi import sentencepiece_digest

    return sentencepiece_digest(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .best_fit_packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_columns import read_wav, store_wav

    read = read_wav(stored(store_wav(table(spark, sf_dir, "documents"))))
    pairs = F.concat_ws(":", F.size("peaks"), F.md5(F.concat_ws(",", F.col("peaks").cast("array<string>"))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", pairs.alias("feature"))


@query
def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_archive import record_digests, write_archive

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    return record_digests(spark, path)


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_NIBBLE = "(instr('0123456789abcdef', substr(d, {}, 1)) - 1)"
_BASE32 = " || ".join(
    f"substr({_LETTERS}, 1 + CAST((({' + '.join(f'{_NIBBLE.format(first + j)} * {16 ** (4 - j)}' for j in range(5))}) // {32**k}) % 32 AS INT), 1)" for first in range(1, 41, 5) for k in (3, 2, 1, 0)
)
ORACLES["op10_warc_archive"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     g AS (SELECT page_id, h, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g
"""


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_ppm_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm_language_id import predict, train

    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def personal_data(docs: DataFrame, model) -> DataFrame:
    """The columns of op4 for any table with ``doc_id`` and ``text``."""
    from .pii_weak_supervision import BASE, KINDS, detect, joined

    found = detect(docs.select("doc_id", "text"), model)
    base = F.filter("found", lambda s: s["kind"].isin(*KINDS[:BASE]))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), *map(count, KINDS[BASE:]))


@query
def op4_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_weak_supervision import train

    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(docs))


@query
def op8_html_page_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_page_difference import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_array_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    cut = F.aggregate("cut", F.lit(0), lambda n, c: n + c["end"] - c["start"])
    return found.select("doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), cut.alias("n_later_words"))


ORACLES["op6_suffix_array_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents),
     s AS (SELECT doc_id, words, CAST(unnest(range(0, greatest(len(words) - 49, 0))) AS INT) AS i FROM w),
     h AS (SELECT doc_id, i, array_to_string(words[i + 1 : i + 50], ' ') AS x FROM s),
     r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS later, count(*) OVER (PARTITION BY x) AS n FROM h),
     a AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r WHERE n > 1),
     b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM a),
     l AS (SELECT doc_id, island, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM b WHERE later),
     c AS (SELECT doc_id, island, sum(least(50, coalesce(next - i, 50))) AS n FROM l GROUP BY doc_id, island)
SELECT b.doc_id, min(b.i) AS start_word, CAST(max(b.i) + 50 AS INT) AS end_word, CAST(max(b.i) + 50 - min(b.i) AS INT) AS n_words, CAST(coalesce(any_value(c.n), 0) AS INT) AS n_later_words
FROM b LEFT JOIN c USING (doc_id, island) GROUP BY b.doc_id, b.island
"""


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extendible_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
     n AS (SELECT doc_id, length(x) AS n, regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') AS norm FROM t),
     g AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("id") % 50 == 0)


ORACLES["op13_hard_negatives"] = """
WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS aid, v.vec_id AS id, a.label = v.label AS same, CAST(list_dot_product(a.q, v.q) AS BIGINT) AS score FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id),
     p AS (SELECT aid, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, id) <= 5),
     n AS (SELECT p.aid AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.aid, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
           FROM p JOIN s ON s.aid = p.aid AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling_variants import MISSING, spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), missing=MISSING)
