"""Territorial facts, location quotients and the measures over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.functions.numbers import ratio
from trajecta.operators import describe, geo, measures
from trajecta.plans import observations as obs
from trajecta.plans.catalog import registered
from trajecta.plans.queries.star import stored_register
from trajecta.session import materialise
from trajecta.sources.register import department_rows, national_rows

KEYS = obs.KEYS


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells as a landed table: their margins and the cells themselves are read."""
    return materialise(obs.cells(spark, sf_dir), "cells")


def _quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.location_quotient(_cells(spark, sf_dir), KEYS)


def _territories(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    codes, regions = obs.code_list(spark, sf_dir), obs.region_list(spark, sf_dir)
    return geo.territory_dim(codes, regions, cells)


@registered(
    "territory_fact",
    f"WITH {obs.TERRITORIAL_FACT} SELECT entity, grp, period, territory, n FROM tfact",
)
def territory_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.territorial_fact(spark, sf_dir)


@registered("territory_rollup", f"WITH {obs.CELLS} SELECT entity, grp, territory, observed FROM cells")
def territory_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.territory_cells(obs.territorial_fact(spark, sf_dir), KEYS)


@registered(
    "location_quotient",
    f"WITH {obs.QUOTIENTS} SELECT entity, grp, territory, observed, expected FROM quotients",
)
def location_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotients(spark, sf_dir)


_TERRITORY_DIM = (
    obs.CELLS
    + ","
    + obs.CODE_LIST
    + """,
territories AS (
  SELECT c.territory, c.label, c.region, r.region_label, length(c.territory) = 3 AS overseas,
         CAST(COALESCE(t.total, 0) AS BIGINT) AS total
  FROM codes c
  LEFT JOIN (SELECT territory, SUM(observed) AS total FROM cells GROUP BY 1) t USING (territory)
  LEFT JOIN regions r ON r.region = c.region)"""
)


@registered("territory_dim", f"WITH {_TERRITORY_DIM} SELECT * FROM territories")
def territory_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _territories(spark, sf_dir, obs.cells(spark, sf_dir))


@registered(
    "cell_coverage",
    f"""WITH {obs.CELLS}
    SELECT COUNT(DISTINCT (entity, grp)) AS entities, COUNT(*) AS cells,
           ROUND(100.0::DOUBLE * COUNT(*) FILTER (WHERE observed >= 30) / COUNT(*), 1) AS pct_shown
    FROM cells""",
)
def cell_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.cell_coverage(obs.cells(spark, sf_dir), keys=KEYS)


@registered(
    "top_specificities",
    f"""WITH {obs.QUOTIENTS},{obs.CODE_LIST}
    SELECT q.entity || '-' || q.grp AS segment, c.label AS territory_label, observed,
           ROUND(expected) AS expected, ROUND(observed / expected, 1) AS index
    FROM quotients q JOIN codes c USING (territory)
    WHERE observed >= 60
    ORDER BY observed / expected DESC, entity, grp, territory LIMIT 12""",
)
def top_specificities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    key = F.struct("entity", "grp")
    name = F.concat(F.col("entity").cast("string"), F.lit("-"), "grp")
    dim = cells.select(*KEYS).distinct().select(key.alias("entity_id"), name.alias("segment"))
    quotients = geo.location_quotient(cells, KEYS).withColumn("entity_id", key)
    return describe.top_specificities(quotients, dim, obs.code_list(spark, sf_dir), floor=60)


@registered(
    "multi_territory_ranking",
    f"""WITH {obs.QUOTIENTS},
    spread AS (SELECT *, COUNT(*) OVER (PARTITION BY entity, grp) AS places FROM quotients)
    SELECT entity, grp, territory, observed, ROUND(observed / expected, 9) AS index
    FROM spread WHERE places > 1""",
)
def multi_territory_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices once entities of a single territory are set aside."""
    kept = measures.in_several_territories(_quotients(spark, sf_dir), KEYS)
    index = F.round(ratio(F.col("observed"), F.col("expected")), 9)
    return kept.select(*KEYS, "territory", "observed", index.alias("index"))


@registered(
    "index_by_region",
    f"""WITH {obs.QUOTIENTS},{obs.CODE_LIST}
    SELECT entity, grp, region, CAST(SUM(observed) AS BIGINT) AS observed,
           ROUND(SUM(expected), 6) AS expected, ROUND(SUM(observed) / SUM(expected), 9) AS index
    FROM quotients JOIN codes USING (territory) GROUP BY 1, 2, 3""",
)
def index_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = obs.code_list(spark, sf_dir).select("territory", "region")
    placed = _quotients(spark, sf_dir).join(codes, "territory")
    rolled = measures.index_by(placed, *KEYS, "region")
    return rolled.withColumns(
        {"expected": F.round("expected", 6), "index": F.round("index", 9)}
    )


@registered(
    "regional_totals",
    f"""WITH {obs.CELLS},{obs.CODE_LIST}
    SELECT entity, grp, region, CAST(SUM(observed) AS BIGINT) AS observed
    FROM cells JOIN codes USING (territory) GROUP BY 1, 2, 3""",
)
def regional_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.by_region(obs.cells(spark, sf_dir), obs.code_list(spark, sf_dir), *KEYS)


@registered(
    "frequency_per_10k",
    f"""WITH {_TERRITORY_DIM}
    SELECT entity, grp, territory, observed,
           CAST(observed * 10000 AS DOUBLE) / total AS frequency
    FROM cells JOIN territories USING (territory)""",
)
def frequency_per_10k(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    rated = measures.frequency(cells, _territories(spark, sf_dir, cells))
    return rated.select(*KEYS, "territory", "observed", "frequency")


@registered(
    "coverage_by_band",
    f"""WITH {obs.REGISTER},
    n AS (SELECT CAST(period - period % 3 AS INTEGER) AS band, SUM(n) AS national FROM national GROUP BY 1),
    l AS (SELECT CAST(period - period % 3 AS INTEGER) AS band, SUM(n) AS local FROM local GROUP BY 1)
    SELECT band, CAST(COALESCE(local, 0) AS BIGINT) AS local, CAST(national AS BIGINT) AS national,
           CAST(COALESCE(local, 0) AS DOUBLE) / national AS coverage
    FROM n LEFT JOIN l USING (band)""",
)
def coverage_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    register = stored_register(spark, sf_dir)
    band = (F.col("period") - F.col("period") % 3).cast("int")
    return measures.coverage_by_band(department_rows(register), national_rows(register), band)


@registered(
    "territory_divergence",
    f"""WITH {obs.CELLS},
    places AS (SELECT territory, CAST(SUM(observed) AS DOUBLE) AS t FROM cells GROUP BY 1),
    entities AS (SELECT entity, grp, CAST(SUM(observed) AS DOUBLE) AS e FROM cells GROUP BY 1, 2),
    whole AS (SELECT SUM(t) AS g FROM places)
    SELECT p.territory,
           ROUND(SUM(ABS(COALESCE(c.observed, 0) / p.t - e.e / w.g)) / 2, 9) AS divergence
    FROM places p CROSS JOIN entities e CROSS JOIN whole w
    LEFT JOIN cells c ON c.entity = e.entity AND c.grp = e.grp AND c.territory = p.territory
    GROUP BY 1""",
)
def territory_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = measures.divergence(_cells(spark, sf_dir), KEYS)
    return scores.withColumn("divergence", F.round("divergence", 9))
