"""Codes of map shapes, to check that a map and a dimension cover each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Only the properties are read; arcs and coordinates are skipped by the parser.
TOPOLOGY = (
    "objects struct<departements:struct<geometries:"
    "array<struct<properties:struct<code:string,nom:string>>>>>"
)


def shape_codes(topology: DataFrame) -> DataFrame:
    """One row per shape from parsed TopoJSON documents."""
    shape = F.explode("objects.departements.geometries.properties").alias("shape")
    return topology.select(shape).select(
        F.col("shape.code").alias("territory"), F.col("shape.nom").alias("shape_label")
    )


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    return shape_codes(spark.read.schema(TOPOLOGY).json(path, multiLine=True))


def map_coverage(shapes: DataFrame, territories: DataFrame) -> DataFrame:
    """Codes on one side only: ``no_shape`` or ``no_territory``."""
    codes = shapes.select("territory")
    known = territories.select("territory")
    return (
        known.join(codes, "territory", "left_anti")
        .withColumn("gap", F.lit("no_shape"))
        .unionByName(
            codes.join(known, "territory", "left_anti").withColumn("gap", F.lit("no_territory"))
        )
    )
