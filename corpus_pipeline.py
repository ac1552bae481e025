"""From raw documents to tokens: language, lines, near-duplicates, benchmark leaks, byte pairs.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before it kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from txlake.catalog.registry import query
from txlake.llm import bpe, decontaminate, language_id, line_dedup, prob_minhash, queries
from txlake.llm.schema_guard import durable, fresh

#: Training, similarity joins and fixpoints aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognized; those without a letter or with a score under 0.4 go."""
    return language_id.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line resembles; ``n_chars`` is that of the new text."""
    return line_dedup.remove_lines(docs).drop("n_lines", "n_removed").withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    copy, = fresh(docs, "_copy")
    copies = prob_minhash.near_duplicates(docs).where("class_id <> doc_id").select(F.col("doc_id").alias(copy)).distinct()
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(copy), "left_anti")


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is covered."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of tokens, and digests of its ids and of the text decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path(queries.BPE_FILE))


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", leaks),
    ("BPE encoding and decoding", tokens),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what each keeps is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, f"stage-{number}")
    return docs
