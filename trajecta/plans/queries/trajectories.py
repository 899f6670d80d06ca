"""Dense profiles, states and shape traits of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators import describe, star, trajectory
from trajecta.plans import observations as obs
from trajecta.plans.catalog import registered

KEYS = obs.KEYS
T = obs.TRAJECTORY


def _grid(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None) -> DataFrame:
    fact = obs.landed_fact(spark, sf_dir) if fact is None else fact
    return trajectory.dense_grid(fact, star.period_dim(fact), KEYS, obs.THRESHOLD)


def _profiles(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None) -> DataFrame:
    return trajectory.profile(_grid(spark, sf_dir, fact), KEYS)


def part_states(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None) -> DataFrame:
    return trajectory.states(_profiles(spark, sf_dir, fact), KEYS)


def part_traits(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None) -> DataFrame:
    return trajectory.traits(
        part_states(spark, sf_dir, fact), KEYS, pivot=obs.PIVOT, vintage=obs.VINTAGE
    )


@registered("eligible_entities", f"WITH {T} SELECT entity, grp, total FROM eligible")
def eligible_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = star.entity_profile(obs.landed_fact(spark, sf_dir), rank=None)
    return trajectory.eligible(profile, obs.THRESHOLD).select("entity", "grp", "total")


@registered(
    "eligibility_coverage",
    f"""WITH {T}
    SELECT COUNT(*) AS eligible,
           ROUND(100 * CAST(SUM(total) AS DOUBLE) / (SELECT SUM(n) FROM fact), 1) AS pct
    FROM eligible""",
)
def eligibility_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = star.entity_profile(obs.landed_fact(spark, sf_dir), rank=None)
    return describe.eligibility_coverage(profile, obs.THRESHOLD)


@registered("dense_grid", f"WITH {T} SELECT entity, grp, period, n FROM grid")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select(*KEYS, "period", "n")


@registered(
    "smoothed_profile",
    f"WITH {T} SELECT entity, grp, period, n, share, smooth, cumulative FROM profiles",
)
def smoothed_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select(*KEYS, "period", "n", "share", "smooth", "cumulative")


@registered("profile_peak", f"WITH {T} SELECT entity, grp, peak_height, peak_period FROM peaks")
def profile_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.peaks(_profiles(spark, sf_dir), KEYS)


@registered(
    "hysteresis_state",
    f"""WITH {T}
    SELECT entity, grp, period, CAST(raw_state AS INTEGER) AS raw_state,
           CAST(state AS INTEGER) AS state FROM states""",
)
def hysteresis_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_states(spark, sf_dir).select(*KEYS, "period", "raw_state", "state")


@registered(
    "strong_runs",
    f"WITH {T} SELECT entity, grp, strong_width, strong_runs FROM measured",
)
def strong_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_traits(spark, sf_dir).select(*KEYS, "strong_width", "strong_runs")


@registered(
    "period_ranks",
    f"WITH {T} SELECT entity, grp, period, n, CAST(place AS INTEGER) AS place FROM placed",
)
def period_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = trajectory.rank_periods(_grid(spark, sf_dir), KEYS)
    return ranked.select(*KEYS, "period", "n", "place")


@registered(
    "concentration_recency",
    f"WITH {T} SELECT entity, grp, concentration, recency FROM traits",
)
def concentration_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_traits(spark, sf_dir).select(*KEYS, "concentration", "recency")


@registered(
    "central_bounds_asymmetry",
    f"WITH {T} SELECT entity, grp, start_period, end_period, asymmetry FROM traits",
)
def central_bounds_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_traits(spark, sf_dir).select(*KEYS, "start_period", "end_period", "asymmetry")


@registered("shape_traits", f"WITH {T} SELECT * FROM traits")
def shape_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_traits(spark, sf_dir)


@registered(
    "trait_distribution",
    f"""WITH {T},
    named AS (
      SELECT unnest(['peak_period', 'strong_width', 'concentration', 'recency', 'asymmetry']) AS trait,
             unnest([CAST(peak_period AS DOUBLE), CAST(strong_width AS DOUBLE), concentration, recency,
                     asymmetry]) AS x
      FROM traits),
    numbered AS (
      SELECT trait, x, row_number() OVER (PARTITION BY trait ORDER BY x) - 1 AS nth,
             COUNT(*) OVER (PARTITION BY trait) - 1 AS top
      FROM named WHERE x IS NOT NULL),
    cut AS (
      -- value at a share of the way from the first row to the last, between its two neighbours
      SELECT trait, share, SUM(x * (1 - ABS(nth - top * share))) AS x
      FROM numbered, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) AS s(share)
      WHERE ABS(nth - top * share) < 1 GROUP BY trait, share)
    SELECT a.trait, ROUND(a.x, 2) AS mini, ROUND(b.x, 2) AS q1, ROUND(c.x, 2) AS median,
           ROUND(d.x, 2) AS q3, ROUND(e.x, 2) AS maxi
    FROM cut a JOIN cut b USING (trait) JOIN cut c USING (trait) JOIN cut d USING (trait) JOIN cut e USING (trait)
    WHERE (a.share, b.share, c.share, d.share, e.share) = (0, 0.25, 0.5, 0.75, 1)""",
)
def trait_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.trait_distribution(part_traits(spark, sf_dir))


@registered(
    "period_count_distribution",
    f"""WITH {T}
    SELECT strong_runs, COUNT(*) AS entities, COUNT(*) FILTER (WHERE ongoing) AS ongoing
    FROM traits GROUP BY strong_runs""",
)
def period_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.run_distribution(part_traits(spark, sf_dir))


@registered(
    "witness_panel",
    f"""WITH {T},
    named AS (
      SELECT p_partkey AS entity, s AS grp, p_brand || ' (' || s || ')' AS segment
      FROM part, (VALUES ('O'), ('F')) AS t(s))
    SELECT segment, peak_period, strong_width, strong_runs, ROUND(concentration, 2) AS concentration,
           ROUND(asymmetry, 2) AS asymmetry, ongoing
    FROM traits JOIN named USING (entity, grp)
    WHERE segment IN ('Brand#7 (O)', 'Brand#7 (F)', 'Brand#12 (O)', 'Brand#25 (F)')""",
)
def witness_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traits of the parts of named brands; the part and status stand in for the key."""
    status = F.explode(F.array(F.lit("O"), F.lit("F"))).alias("grp")
    key = F.struct("entity", "grp").alias("entity_id")
    dim = (
        obs.table(spark, sf_dir, "part")
        .select(F.col("p_partkey").alias("entity"), "p_brand", status)
        .select(key, F.concat("p_brand", F.lit(" ("), "grp", F.lit(")")).alias("segment"))
    )
    traits = part_traits(spark, sf_dir).withColumn("entity_id", F.struct("entity", "grp"))
    names = ["Brand#7 (O)", "Brand#7 (F)", "Brand#12 (O)", "Brand#25 (F)"]
    return describe.witness_panel(traits, dim, names)
