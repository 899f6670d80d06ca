"""The long-format register: one row per level × territory × sex × name × period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.functions.constants import DEPARTMENT, NATIONAL

REGISTER_COLUMNS = (
    "niveau_geographique", "geographie", "sexe", "prenom", "periode", "valeur", "rang",
)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Parquet keeps its own types, which differ between vintages; the casts come later."""
    register = spark.read.parquet(path)
    missing = [c for c in REGISTER_COLUMNS if c not in register.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return register


def land_register(register: DataFrame, path: str) -> DataFrame:
    """Copy the register into one folder per geographic level and read it back.

    The stages and checks read it several times, each time one level only; the folders
    let a scan skip the other levels altogether.
    """
    register.write.mode("overwrite").partitionBy("niveau_geographique").parquet(path)
    return read_register(register.sparkSession, path)


def read_code_list(spark: SparkSession, path: str) -> DataFrame:
    """The official code list; every column is text, or ``01`` would become 1.

    The header decides the columns, so its order and extra columns do not matter.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(
        F.col("DEP").alias("territory"), F.col("LIBELLE").alias("label"), F.col("REG").alias("region")
    )


_PERIOD = "try_cast(periode AS INT)"
_GROUP = "try_cast(sexe AS SMALLINT)"


def row_fate() -> Column:
    """What the reading of a level does with a row.

    ``no_period`` (a period that is no number) and ``rare`` (no name, or a bucket of rare names,
    which starts with an underscore) are dropped.  ``bad_period`` (a number that is no year),
    ``bad_group`` and ``bad_count`` are refused.  Everything else is ``kept``.
    """
    period, group = F.expr(_PERIOD), F.expr(_GROUP)
    return (
        F.when(period.isNull(), "no_period")
        .when(F.coalesce(F.col("prenom").startswith("_"), F.lit(True)), "rare")
        .when(~period.between(-32768, 32767), "bad_period")
        .when(group.isNull(), "bad_group")
        .when(F.expr("try_cast(valeur AS BIGINT)").isNull(), "bad_count")
        .otherwise("kept")
    )


def clean_rows(register: DataFrame, level: str) -> DataFrame:
    """Rows of one geographic level, renamed and typed.

    The level filter is vital: region codes also occur as department codes.  Rows that
    ``row_fate`` drops are gone; one that it refuses stops the query and is named, since a
    silent null would be exported.
    """
    fate = row_fate()
    refused = F.raise_error(
        F.concat_ws(
            " ", F.lit("register row refused:"), fate, "niveau_geographique", "geographie", "sexe", "prenom",
            F.col("periode").cast("string"), F.col("valeur").cast("string"),
        )
    )

    def strict(value: str) -> Column:
        """``value`` of a kept row; rows to be dropped may be met before the filter."""
        wrong = (F.col("niveau_geographique") == level) & fate.startswith("bad_")
        return F.when(wrong, refused).otherwise(F.expr(value))

    return register.filter((F.col("niveau_geographique") == level) & ~fate.isin("no_period", "rare")).select(
        strict(_GROUP).cast(T.ShortType()).alias("grp"),
        F.col("prenom").alias("entity"),
        strict("try_cast(periode AS SMALLINT)").cast(T.ShortType()).alias("period"),
        F.col("geographie").alias("territory"),
        strict("try_cast(valeur AS BIGINT)").cast(T.LongType()).alias("n"),
        F.col("rang").cast(T.IntegerType()).alias("rank"),
    )


def national_rows(register: DataFrame) -> DataFrame:
    return clean_rows(register, NATIONAL).drop("territory")


def department_rows(register: DataFrame) -> DataFrame:
    return clean_rows(register, DEPARTMENT).drop("rank")
