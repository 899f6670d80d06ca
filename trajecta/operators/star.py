"""Star schema: dimensions with deterministic keys and facts with additive measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.functions.constants import GROUP_LABELS
from trajecta.functions.labels import group_suffix, search_key, segment_label, title_case
from trajecta.functions.numbers import decade, ratio
from trajecta.operators.keys import dense_key
from trajecta.session import materialise


def values_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A constant relation the planner knows the size of."""
    fields = [f.strip() for f in schema.split(",")]
    records = F.array(*[F.struct(*[F.lit(v) for v in row]) for row in rows])
    typed = f"array<struct<{','.join(':'.join(f.split()) for f in fields)}>>"
    return spark.range(1).select(F.inline(records.cast(typed)))


def group_dim(spark: SparkSession) -> DataFrame:
    return values_table(spark, GROUP_LABELS, "grp smallint, label string")


def period_dim(fact: DataFrame) -> DataFrame:
    """The periods that occur, never a generated range: an absent one must not appear."""
    kind = fact.schema["period"].dataType
    return fact.select("period").distinct().select(
        "period", decade(F.col("period")).cast(kind).alias("decade")
    )


def entity_profile(fact: DataFrame, *, rank: str | None = "rank") -> DataFrame:
    """Totals, extent and peak per (entity, group).  On a tied peak the earliest wins."""
    measures = [
        F.sum("n").cast("long").alias("total"),
        F.min("period").alias("first_period"),
        F.max("period").alias("last_period"),
        F.max_by("period", F.struct("n", (-F.col("period")).alias("early"))).alias("peak_period"),
        F.max("n").alias("peak_n"),
    ]
    if rank:
        measures.append(F.min(rank).alias("best_rank"))
    return fact.groupBy("entity", "grp").agg(*measures)


def with_shared_flag(profile: DataFrame) -> DataFrame:
    """``shared``: the entity occurs in more than one group."""
    return profile.withColumn("shared", F.count("*").over(Window.partitionBy("entity")) > 1)


def with_labels(profile: DataFrame, suffix: Column | None = None) -> DataFrame:
    """Display form, search form and a segment label that is unique per (entity, group)."""
    suffix = group_suffix(F.col("grp")) if suffix is None else suffix
    return (
        profile.withColumn("display", title_case(F.col("entity")))
        .withColumn("search", search_key(F.col("entity")))
        .withColumn("segment", segment_label(F.col("display"), F.col("shared"), suffix))
    )


def entity_dim(fact: DataFrame, suffix: Column | None = None, rank: str | None = "rank") -> DataFrame:
    """One row per (entity, group) with a dense key in (entity, group) order."""
    described = with_labels(with_shared_flag(entity_profile(fact, rank=rank)), suffix)
    return dense_key(described, ["entity", "grp"])


def with_entity_id(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Attach the key on both natural columns; on the name alone shared names would double."""
    return fact.join(dim.select("entity", "grp", "entity_id"), ["entity", "grp"])


def with_cell_share(fact: DataFrame, cell: Sequence[str] = ("period", "grp")) -> DataFrame:
    """Share of each row in its (period, group) total.

    There are few cells and each is heavy, so a window over them would put most rows in a
    handful of tasks.  The totals are summed map-side into a small table instead.
    """
    totals = materialise(
        fact.groupBy(*cell).agg(F.sum("n").alias("_cell_total")), "cell-totals"
    )
    return (
        fact.join(totals, list(cell))
        .withColumn("share", ratio(F.col("n"), F.col("_cell_total")))
        .drop("_cell_total")
    )


def period_fact(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """National fact: key, period, count, source rank and share in (period, group)."""
    return with_entity_id(with_cell_share(fact), dim).select(
        "entity_id", "period", "n", "rank", "share"
    )
