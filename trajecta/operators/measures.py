"""Report measures over the star: indices, frequencies, coverage, diversity, search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.labels import search_key
from trajecta.functions.numbers import decade, ratio
from trajecta.operators.trajectory import ENTITY
from trajecta.session import materialise


def index_by(quotients: DataFrame, *by: str) -> DataFrame:
    """Σ observed / Σ expected at any grouping; a mean of ratios would be wrong."""
    return quotients.groupBy(*by).agg(
        F.sum("observed").cast("long").alias("observed"),
        F.sum("expected").alias("expected"),
        ratio(F.sum("observed"), F.sum("expected")).alias("index"),
    )


def by_region(rows: DataFrame, territories: DataFrame, *keys: str, value: str = "observed") -> DataFrame:
    """Regional figures as the sum of their territories, never a separate regional level."""
    return (
        rows.join(territories.select("territory", "region"), "territory")
        .groupBy(*keys, "region")
        .agg(F.sum(value).alias(value))
    )


def frequency(cells: DataFrame, territories: DataFrame, per: int = 10_000) -> DataFrame:
    """Count per ``per`` counts of the territory; empty where the territory has none."""
    denominator = territories.select("territory", F.col("total").alias("_total"))
    rate = ratio(F.col("observed") * F.lit(per), F.col("_total"))
    return cells.join(denominator, "territory").withColumn("frequency", rate).drop("_total")


def in_several_territories(cells: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Drop entities found in one territory only: their index is at its maximum by nature.

    ``cells`` has one row per entity and territory, so counting rows counts territories.
    """
    spread = F.count("*").over(Window.partitionBy(*keys))
    return cells.withColumn("_spread", spread).filter("_spread > 1").drop("_spread")


def coverage_by_band(local: DataFrame, national: DataFrame, band: Column) -> DataFrame:
    """Share of the national count that the territorial level covers, per band of periods."""
    columns = []
    for name, df in (("local", local), ("national", national)):
        columns.append(df.groupBy(band.alias("band")).agg(F.sum("n").cast("long").alias(name)))
    return (
        columns[1]
        .join(columns[0], "band", "left")
        .select("band", F.coalesce("local", F.lit(0).cast("long")).alias("local"), "national")
        .withColumn("coverage", ratio(F.col("local"), F.col("national")))
    )


def divergence(cells: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """½ Σ |share in the territory − share overall|, from 0 (same mix) to 1 (disjoint).

    Our definition.  Cells that do not exist are not built: the entities a territory lacks
    add up to what its present entities leave of the overall composition.
    """
    totals = materialise(
        cells.groupBy("territory").agg(F.sum("observed").alias("_territory")), "territory-totals"
    )
    grand = totals.agg(F.sum("_territory")).scalar()
    here = ratio(F.col("observed"), F.col("_territory"))
    overall = ratio(F.col("_entity"), F.col("_grand"))
    return (
        cells.withColumn("_entity", F.sum("observed").over(Window.partitionBy(*keys)))
        .join(totals, "territory")
        .withColumn("_grand", grand)
        .groupBy("territory")
        .agg(
            F.sum(F.abs(here - overall)).alias("_gap"),
            F.sum(overall).alias("_present"),
        )
        .select("territory", ((F.col("_gap") + 1 - F.col("_present")) / 2).alias("divergence"))
    )


def diversity(fact: DataFrame, keys: Sequence[str] = ENTITY, top: int = 10) -> DataFrame:
    """Distinct entities, Shannon entropy and share of the ``top`` entities per period.

    Our definition, meant for the national level.  ``fact`` is at (keys, period) grain.
    Entropy is ln T − Σ n·ln n / T, so one map-side sum is enough; the top list is cut in
    each task before it is shuffled.
    """
    n = F.col("n")
    summary = (
        fact.filter(n > 0)
        .groupBy("period")
        .agg(
            F.count("*").alias("entities"),
            F.sum("n").cast("long").alias("total"),
            F.sum(n * F.log(n)).alias("_weighted_log"),
        )
    )
    best_first = Window.partitionBy("period").orderBy(n.desc(), *keys)
    leaders = (
        fact.withColumn("_place", F.row_number().over(best_first))
        .filter(F.col("_place") <= F.lit(top))
        .groupBy("period")
        .agg(F.sum("n").alias("_leading"))
    )
    return summary.join(leaders, "period").select(
        "period",
        "entities",
        "total",
        (F.log("total") - ratio(F.col("_weighted_log"), F.col("total"))).alias("entropy"),
        ratio(F.col("_leading"), F.col("total")).alias("top_share"),
    )


def search(dim: DataFrame, text: str, *, prefix: bool = False) -> DataFrame:
    """Entities whose search form equals, or starts with, ``text`` typed in any way."""
    wanted = search_key(F.lit(text))
    key = F.col("search")
    return dim.filter(key.startswith(wanted) if prefix else key == wanted)


def curve(fact: DataFrame, **key: object) -> DataFrame:
    """The popularity curve of one entity, e.g. ``curve(fact, entity_id=12)``."""
    for name, value in key.items():
        fact = fact.filter(F.col(name) == F.lit(value))
    return fact


def decade_trend(fact: DataFrame, *keys: str, size: int = 10) -> DataFrame:
    """Counts per block of ``size`` periods."""
    return fact.groupBy(*keys, decade(F.col("period"), size).alias("decade")).agg(
        F.sum("n").cast("long").alias("n")
    )
