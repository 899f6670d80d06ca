"""Labelled samples of bounded size, and folds of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int
) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``per_class`` documents for each of 0 and 1.

    Rows of the held-out fold never take part.  A doc_id that is labelled more than once counts
    with its larger label; null labels, null ids and other values are left out.  The choice
    follows a hash of the id, so it does not depend on the layout of the tables.  A doc_id in many
    rows gives one of its texts, the one with the least hash: ``2 * per_class`` rows at most, whose
    ids go to all tasks.  Each task keeps one text of an id, so none is gathered.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(remainder(F.col("doc_id"), folds) != held)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    spot = (F.xxhash64("doc_id"), F.col("doc_id"))
    # Each task keeps its own first rows, so no class is gathered.
    first = [known.filter(F.col("label") == c).orderBy(*spot).limit(per_class) for c in (0, 1)]
    chosen = first[0].union(first[1]).select(F.col("doc_id").alias("chosen_id"), "label")
    texts = docs.select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))
    return rows.groupBy("doc_id", "label").agg(one_text()).select("doc_id", "text", "label")


def one_text() -> Column:
    """The text of a group with the least hash, whatever the order of its rows."""
    return F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
