"""The corpus pipeline: documents go through five stages and leave as packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import best_fit_packing, pii_weak_supervision, quality_rules, simhash_near_dedup, suffix_array_dedup
from skylattice.llm.common import shared_dir, table
from skylattice.llm.queries import vocabulary

#: Columns of documents; a stage takes these of its input, whatever else there is, and all but the last return them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go. Rows are judged one by one, so repeated rows stay or go alike, null ids too;
    texts are judged whole, whatever their length. An empty table stays empty; columns that are none of documents are
    left out, whatever their names.
    """
    return quality_rules.quality_filter(docs.select(*COLUMNS), vocabulary("piece_bpe_32k.model"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, null ids last.

    Of rows that repeat id and text one stays; rows that share an id but not the text are documents of their own. Texts
    without words are no near-duplicates of others. An empty table stays empty; columns that are none of documents are
    left out.
    """
    return simhash_near_dedup.near_dedup(docs.select(*COLUMNS))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages are cut out of the texts, and ``n_chars`` follows.

    The first occurrence is that of the smallest id, null ids last; rows that repeat id and text are cut alike. Null and
    short texts are as they were, and no row goes. An empty table stays empty; columns that are none of documents are
    left out.
    """
    return suffix_array_dedup.suffix_dedup(docs.select(*COLUMNS))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind, and ``n_chars`` follows.

    Null and empty texts are as they were; rows are treated one by one, repeated ones and null ids alike, and no row goes.
    An empty table stays empty; columns that are none of documents are left out.
    """
    docs = docs.select(*COLUMNS)
    return pii_weak_supervision.redact(docs, pii_weak_supervision.train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of at most 4096 tokens: a row a piece, with its tokens in ``ids``, little-endian 32-bit numbers.

    Null and empty texts are one closing id; repeated rows, and rows that share an id or have none, are packed separately.
    Ties between pieces of one length go by a hash of the piece. An empty table gives no rows; other columns are left out.
    """
    return best_fit_packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", passage_dedup), ("PII", private_data), ("best-fit packing", packing)]

#: SQL has no tokenizer, no 64-bit SimHash and no estimation; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each one leaves is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{where}/{k}")
            docs = spark.read.parquet(f"{where}/{k}")
    return docs
