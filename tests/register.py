"""A synthetic register: three levels in one column, all edge cases of names, no faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.constants import REGION_LABELS

FIRST, LAST = 1900, 2025

SPECIAL = ["JEAN-PIERRE", "ÉLIE", "LÉO", "ŒIL", "A--B", "ŸANN", "MARIE", "JEAN", "KEVIN", "LOUISE", "EMMA"]
BOTH_SEXES = ["CAMILLE", "DOMINIQUE", "ANDRÉA"]


def codes() -> list[tuple[str, str, str]]:
    """101 departments: 01 to 95 with 2A and 2B instead of 20, and five overseas ones."""
    mainland = [f"{i:02d}" for i in range(1, 96) if i != 20] + ["2A", "2B"]
    overseas = ["971", "972", "973", "974", "976"]
    regions = [code for code, _ in REGION_LABELS]
    rows = [(c, f"Dép. {c}", regions[5 + i % 13]) for i, c in enumerate(mainland)]
    return rows + [(c, f"Dép. {c}", regions[i]) for i, c in enumerate(overseas)]


def write_codes(spark: SparkSession, path: str) -> None:
    df = spark.createDataFrame(codes(), "DEP string, LIBELLE string, REG string")
    df.select("DEP", "REG", F.lit("x").alias("CHEFLIEU"), "LIBELLE").coalesce(1).write.csv(path, header=True)


def _curves(spark: SparkSession) -> DataFrame:
    """(sexe, prenom, periode, n): one bell per pair, its place and width set by the name."""
    names = [(n, s) for n in BOTH_SEXES for s in ("1", "2")]
    names += [(n, "1" if i % 2 else "2") for i, n in enumerate(SPECIAL)]
    rows = [
        (name, sex, 1905 + (i * 29) % 118, 5 + (i * 7) % 36, 9000 + 1700 * (i % 6))
        for i, (name, sex) in enumerate(names)
    ]
    rows.append(("RARISSIME", "2", 1960, 2, 60))
    pairs = spark.createDataFrame(rows, "prenom string, sexe string, centre int, width int, height int")
    years = F.explode(F.sequence(F.lit(FIRST), F.lit(LAST))).alias("year")
    bell = F.exp(-F.pow((F.col("year") - F.col("centre")) / F.col("width"), 2))
    return (
        pairs.select("*", years)
        .withColumn("n", (F.round(F.col("height") * bell / 5) * 5).cast("bigint"))
        .filter("n > 0")
        .select("sexe", "prenom", F.col("year").cast("string").alias("periode"), "n")
    )


def register(spark: SparkSession) -> DataFrame:
    national = _curves(spark)
    places = spark.createDataFrame(codes(), "geographie string, label string, region string")
    places = places.withColumn("size", 0.5 + (F.abs(F.xxhash64("geographie")) % 100) / 100.0)
    total = places.agg(F.sum("size")).first()[0]
    # A name is up to 30 % more or less frequent in a department than its size says.
    taste = 0.7 + (F.abs(F.xxhash64("geographie", "prenom")) % 60) / 100.0
    share = F.col("size") / F.lit(total) * taste
    departments = (
        national.crossJoin(places)
        .withColumn("valeur", (F.floor(F.col("n") * share / 5) * 5).cast("bigint"))
        .filter("valeur > 0")
    )
    regions = departments.groupBy("region", "sexe", "prenom", "periode").agg(F.sum("valeur").alias("valeur"))
    levels = [
        national.select(F.lit("FRANCE").alias("niveau_geographique"), F.lit("FR").alias("geographie"),
                        "sexe", "prenom", "periode", F.col("n").alias("valeur")),
        regions.select(F.lit("REG"), "region", "sexe", "prenom", "periode", "valeur"),
        departments.select(F.lit("DEP"), "geographie", "sexe", "prenom", "periode", "valeur"),
    ]
    rows = levels[0].union(levels[1]).union(levels[2])
    return rows.withColumn("rang", (F.abs(F.xxhash64("prenom", "periode")) % 500 + 1).cast("int"))
