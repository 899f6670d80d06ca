"""From raw documents to token ids: five stages, each an operator of ``trajecta.llm``.

A stage takes all documents that the one before kept.  All but the last return the columns of
``documents``, extra ones included.  Each stage takes nulls in any column, empty, blank and very long
texts, repeated rows and an empty table, as its docstring says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import bpe, mixing, passages, simhash, toxicity
from trajecta.llm.columns import small_batches
from trajecta.llm.queries import vocabulary
from trajecta.session import delete_folder, scratch_dir, scratch_scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    A null or empty text is scored like any other; rows alike are scored alike, so repeats stay or go
    together.  Without labels of both classes, every document stays.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group.

    Texts without words form one group.  Of a group's rows without a doc_id one more stays, as nothing
    can name them; of rows that are alike one stays.
    """
    return simhash.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each repeated passage left at its first place only.

    Rows without a doc_id or text, and texts under fifty words, stay as they are; a document all of
    whose words stand elsewhere goes.
    """
    return passages.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix; one that the mix takes twice comes twice.

    A null source is a source of its own.  Texts without words take no part in the mix and are left out.
    """
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of the text they decode to; a null text has none."""
    encoded = bpe.encode(docs, vocabulary())
    return encoded.select(
        "doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("passages", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

# Rows that a stage hands its Python workers at a time; an executor runs several of them beside a full heap.
BATCH_ROWS = 1000

# Three of the stages are beyond SQL; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each stage's result is written to the shared folder; what the stage wrote besides, and the result
    that it read, are deleted once it is there, so only the last one is left when all is done.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        with scratch_scope(spark), small_batches(spark, BATCH_ROWS):
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
