"""Territorial facts and location quotients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.functions.constants import REGION_LABELS
from trajecta.operators.star import values_table, with_entity_id
from trajecta.operators.trajectory import ENTITY
from trajecta.session import materialise


def territory_fact(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Territorial rows keyed by the entity dimension; the source rank is dropped because
    it is computed per level and must not sit next to a national one."""
    return with_entity_id(rows, dim).select("entity_id", "period", "territory", "n")


def territory_cells(fact: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """All periods summed, from the yearly fact so the two grains cannot drift apart."""
    return fact.groupBy(*keys, "territory").agg(F.sum("n").cast("long").alias("observed"))


def territory_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("territory").agg(F.sum("observed").cast("long").alias("territory_total"))


def location_quotient(cells: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Observed and expected count per cell; expected = row × column / grand total.

    Both margins come from ``cells`` itself, never from the national level.  An entity has
    one row per territory, so its margin is a window; a territory may hold a large part of
    all cells, so its margin is summed map-side and looked up.  The ratio is not stored:
    it is only right as a quotient of sums.
    """
    totals = materialise(territory_totals(cells), "territory-totals")
    grand = totals.agg(F.sum("territory_total")).scalar()
    row = F.sum("observed").over(Window.partitionBy(*keys))
    # Two bigint margins overflow a bigint product, so it is formed as a decimal.
    wide = "decimal(19,0)"
    product = (F.col("_row").cast(wide) * F.col("territory_total").cast(wide)).cast("double")
    return (
        cells.withColumn("_row", row)
        .join(totals, "territory")
        .select(*keys, "territory", "observed", (product / grand.cast("double")).alias("expected"))
    )


def region_labels(spark: SparkSession) -> DataFrame:
    return values_table(spark, REGION_LABELS, "region string, region_label string")


def territory_dim(codes: DataFrame, regions: DataFrame, cells: DataFrame) -> DataFrame:
    """Code list with region label, overseas flag and the denominator of frequencies.

    ``codes`` has territory, label and region as text.  A territory without any count
    stays in the dimension with a total of zero.
    """
    totals = materialise(territory_totals(cells), "territory-totals")
    return (
        codes.join(totals, "territory", "left")
        .join(regions, "region", "left")
        .select(
            "territory",
            "label",
            "region",
            "region_label",
            (F.length("territory") == 3).alias("overseas"),
            F.coalesce("territory_total", F.lit(0).cast("long")).alias("total"),
        )
    )
