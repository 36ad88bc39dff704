"""A corpus from raw documents to packed sequences, as stages over Parquet tables.

Each stage takes the session, its predecessor's rows as ``docs`` and the folder of tables, and calls one operator. All
but the last return the columns of ``documents``. ``n_chars`` counts the characters of the text as the stage leaves it.

1. toxicity: fits its model to the labelled documents among its input, scores all of them, and drops those at or above
   the threshold. Documents without a score stay.
2. line dedup: lines that an earlier document holds go.
3. near duplicates: of each group of documents whose shingle sets are alike, the one of the smallest id stays.
4. suffix dedup: passages of 50 words or more that an earlier document holds go.
5. packing: the documents' tokens as pieces of sequences.

Defined results of all stages: a null text stays null (line dedup makes it one empty line, packing the end token alone),
an empty one empty. Rows without id are no one's duplicates in stages 3 and 4 and, as the last document, lose lines in
stage 2 that others hold. Rows of equal id are one document: they stay or go together in stage 3. Columns beyond those
of ``documents`` are dropped, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, minhash, packing, suffixes, toxicity
from tidemark.llm.shared import shared_dir
from tidemark.llm.text import small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(toxicity.fit(docs, labels).keep(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that documents of smaller ids hold."""
    small_batches(spark)
    return _documents(lines.dedup_lines(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, a similarity of 0.8 or more."""
    small_batches(spark)
    judged = minhash.near_components(docs, percent=80)
    gone = judged.filter(~F.col("kept")).select("doc_id").distinct()
    return _documents(docs.join(gone, "doc_id", "left_anti"))


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller ids hold."""
    small_batches(spark)
    return _documents(suffixes.dedup_passages(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
