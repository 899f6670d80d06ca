"""Archetype dimension, bridge to the entities, and mean curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.constants import UNCLASSIFIED
from trajecta.operators.star import values_table
from trajecta.operators.trajectory import ENTITY


def archetype_dim(spark: SparkSession, labels: Sequence[str]) -> DataFrame:
    """One row per configured label, numbered from 1, plus group 0 for the unclassified."""
    none = values_table(
        spark, [(*UNCLASSIFIED, False)], "archetype int, label string, classified boolean"
    )
    named = spark.range(1).select(F.posexplode(F.lit(list(labels))).alias("at", "label"))
    return none.unionByName(
        named.select((F.col("at") + 1).alias("archetype"), "label", F.lit(True).alias("classified"))
    )


def expose_assignment(assignment: DataFrame, view: str = "affectation") -> None:
    """Make the assignment a relation for SQL; it stays distributed."""
    assignment.select(
        F.col("entity_id").alias("prenom_id"),
        F.col("archetype").alias("groupe"),
        F.col("distance").alias("distance_centre"),
    ).createOrReplaceTempView(view)


def bridge(dim: DataFrame, assignment: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Every entity once: its group, or 0 with no distance where it was not classified."""
    return (
        dim.select(*keys)
        .join(assignment.select(*keys, "archetype", "distance"), list(keys), "left")
        .withColumn("archetype", F.coalesce("archetype", F.lit(0)))
    )


def mean_curve(profiles: DataFrame, assignment: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Unweighted mean of the smoothed profiles of each group: every entity counts the same."""
    return (
        profiles.select(*keys, "period", "smooth")
        .join(assignment.select(*keys, "archetype"), list(keys))
        .groupBy("archetype", "period")
        .agg(F.avg("smooth").alias("mean_share"))
    )
