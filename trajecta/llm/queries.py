"""Registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.llm import (
    bpe,
    byte_bpe,
    conversations,
    language,
    mixing,
    neighbours,
    passages,
    phrases,
    quality,
    rollups,
    search,
    simhash,
    toxicity,
)
from trajecta.session import materialise, scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every vector whose id is divisible by 20."""
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best other documents for the text of every document whose id is divisible by 50."""
    return search.top_k(_table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that repeat an earlier one."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def vocabulary(path: str | None = None) -> str:
    """Definition of the word vocabulary; ``path`` replaces the public file."""
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language.identify(_table(spark, sf_dir, "documents"))


TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "letters-2": r"[\p{L}\p{N}]+"}
WORDED = r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*"


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after a load of all documents, a delete, a revision and a replay.

    Documents labelled toxic are deleted; of the others, those labelled low in quality have
    their words counted again, without words that hold neither letter nor digit.
    """
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    counts = rollups.count_tokens(docs, TOKENIZERS | {"words-1 revised": WORDED})
    counts = materialise(counts.join(labels, "doc_id", "left"), "counts")
    current, revision = counts.filter("version <> 'words-1 revised'"), F.lit("words-1").alias("version")
    low = counts.filter("quality = 0 AND coalesce(toxic, 0) <> 1")
    new = low.filter("version = 'words-1 revised'").select("source", "lang", revision, "n_tokens")
    toxic = rollups.signed(current.filter("toxic = 1"), -1)
    totals = rollups.Rollup(spark, f"{scratch_dir(spark)}/rollup-{uuid.uuid4().hex}")
    totals.commit("load", rollups.signed(current, 1))
    totals.commit("delete", toxic)
    totals.commit("revise", rollups.revised(low.filter("version = 'words-1'"), new))
    totals.commit("delete", toxic)
    return totals.totals()


ROLLUP_ORACLE = r"""
WITH label AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
kept AS (
  SELECT d.source, d.lang, coalesce(d.text, '') AS text, l.quality
  FROM documents d LEFT JOIN label l ON d.doc_id = l.doc_id WHERE l.toxic IS DISTINCT FROM 1
), counted AS (
  SELECT source, lang, 'letters-2' AS version, len(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS n FROM kept
  UNION ALL
  SELECT source, lang, 'words-1',
         len(regexp_extract_all(text, CASE WHEN quality = 0 THEN '[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*'
                                           ELSE '[^\x20\x09-\x0D]+' END)) FROM kept
)
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM counted GROUP BY source, lang, version
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after some rows have been damaged."""
    rows = _table(spark, sf_dir, "conversations")
    return conversations.audited(rows, conversations.damage(rows))


def ranks(path: str | None = None) -> bytes:
    """Content of the rank file; ``path`` replaces the public one."""
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read()


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level token ids of every document and the bytes they decode to, as digests."""
    return byte_bpe.digests(_table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_neighbours": op1_neighbours,
    "op2_search": op2_search,
    "op3_passages": op3_passages,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_language": op8_language,
    "op9_token_rollup": op9_token_rollup,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op5_mixing": mixing.ORACLE.strip(),
    "op9_token_rollup": ROLLUP_ORACLE.strip(),
    "op13_collocations": phrases.ORACLE.strip(),
}
