"""Descriptive tables that let a person judge a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.numbers import ratio
from trajecta.operators.quantiles import exact_quantiles
from trajecta.operators.star import values_table
from trajecta.operators.trajectory import ENTITY

TRAITS = ("peak_period", "strong_width", "concentration", "recency", "asymmetry")


def eligibility_coverage(dim: DataFrame, threshold: int) -> DataFrame:
    """How many entities pass the threshold and what part of all counts they hold."""
    passes = F.col("total") >= F.lit(threshold)
    kept = F.sum(F.when(passes, F.col("total")))
    return dim.agg(
        F.count_if(passes).alias("eligible"),
        F.round(ratio(F.lit(100) * kept, F.sum("total")), 1).alias("pct"),
    )


def unpivot_traits(traits: DataFrame, names: Sequence[str] = TRAITS) -> DataFrame:
    """(trait, value) rows, nulls dropped."""
    numeric = traits.select(*[F.col(c).cast("double").alias(c) for c in names])
    return numeric.unpivot([], list(names), "trait", "value").filter(F.col("value").isNotNull())


def trait_distribution(traits: DataFrame, names: Sequence[str] = TRAITS) -> DataFrame:
    """Minimum, quartiles and maximum of each trait."""
    points = {"mini": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maxi": 1.0}
    spread = exact_quantiles(unpivot_traits(traits, names), "value", points, ["trait"])
    return spread.select("trait", *[F.round(c, 2).alias(c) for c in points])


def run_distribution(traits: DataFrame) -> DataFrame:
    """Entities by number of strong runs, and how many of them are still going on."""
    return traits.groupBy("strong_runs").agg(
        F.count("*").alias("entities"), F.count_if("ongoing").alias("ongoing")
    )


def witness_panel(traits: DataFrame, dim: DataFrame, witnesses: Sequence[str]) -> DataFrame:
    """Traits of named entities, to notice at once when a trait stops making sense.

    The names come as a relation: a name that is listed twice is shown twice.
    """
    wanted = values_table(traits.sparkSession, [(w,) for w in witnesses], "segment string")
    named = dim.select("entity_id", "segment").join(wanted, "segment")
    return traits.join(named, "entity_id").select(
        "segment",
        "peak_period",
        "strong_width",
        "strong_runs",
        F.round("concentration", 2).alias("concentration"),
        F.round("asymmetry", 2).alias("asymmetry"),
        "ongoing",
    )


def group_composition(bridge: DataFrame, archetypes: DataFrame, traits: DataFrame,
                      keys: Sequence[str] = ENTITY) -> DataFrame:
    """Size, peak range and medians of each group.

    Groups are few and may be huge, so the medians go through the distributed quantiles.
    """
    members = traits.join(bridge.select(*keys, "archetype"), list(keys))
    summary = members.groupBy("archetype").agg(
        F.count("*").alias("entities"),
        F.min("peak_period").alias("peak_min"),
        F.max("peak_period").alias("peak_max"),
        F.count_if("ongoing").alias("ongoing"),
    )
    digits = {"peak_period": 0, "strong_width": 0, "concentration": 2}
    long = members.select(
        "archetype", *[F.col(c).cast("double").alias(c) for c in digits]
    ).unpivot(["archetype"], list(digits), "measure", "value")
    middle = exact_quantiles(long, "value", {"median": 0.5}, ["archetype", "measure"])
    medians = middle.groupBy("archetype").agg(
        *[
            F.max(F.when(F.col("measure") == c, F.round("median", d))).alias(f"{c}_median")
            for c, d in digits.items()
        ]
    )
    labels = archetypes.select("archetype", "label")
    return summary.join(medians, "archetype").join(labels, "archetype")


def representatives(bridge: DataFrame, dim: DataFrame, size: int = 6) -> DataFrame:
    """The segment labels nearest each centre, in order of distance.

    The window limit is applied in each task before the shuffle, so a huge group costs no
    more than a small one.
    """
    nearest = Window.partitionBy("archetype").orderBy("distance", "entity_id")
    kept = (
        bridge.filter(F.col("archetype") > 0)
        .withColumn("place", F.row_number().over(nearest))
        .filter(F.col("place") <= F.lit(size))
    )
    return (
        kept.join(dim.select("entity_id", "segment"), "entity_id")
        .groupBy("archetype")
        .agg(F.expr("listagg(segment, ', ') WITHIN GROUP (ORDER BY place)").alias("members"))
    )


def cell_coverage(quotients: DataFrame, floor: int = 30, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Entities present, cells stored, and the share of cells at or above ``floor``."""
    # Entities are counted through a first aggregate so no task holds them all.
    per_entity = quotients.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.count_if(F.col("observed") >= F.lit(floor)).alias("shown")
    )
    shown = F.lit(100) * F.sum("shown")
    return per_entity.agg(
        F.count("*").alias("entities"),
        F.sum("cells").alias("cells"),
        F.round(ratio(shown, F.sum("cells")), 1).alias("pct_shown"),
    )


def top_specificities(quotients: DataFrame, dim: DataFrame, territories: DataFrame,
                      floor: int = 500, size: int = 12) -> DataFrame:
    """The highest indices among cells of at least ``floor`` counts.

    The short list is cut before the labels are joined, so only ``size`` rows look them up.
    """
    index = ratio(F.col("observed"), F.col("expected"))
    leading = (
        quotients.filter(F.col("observed") >= F.lit(floor))
        .withColumn("_index", index)
        .orderBy(F.col("_index").desc(), "entity_id", "territory")
        .limit(size)
    )
    return (
        leading.join(dim.select("entity_id", "segment"), "entity_id")
        .join(territories.select("territory", F.col("label").alias("territory_label")), "territory")
        .orderBy(F.col("_index").desc(), "entity_id", "territory")
        .select(
            "segment",
            "territory_label",
            "observed",
            F.round("expected").alias("expected"),
            F.round("_index", 1).alias("index"),
        )
    )
