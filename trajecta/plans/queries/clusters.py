"""Archetypes of part trajectories: assignment, separation, reproducibility, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.config import Settings
from trajecta.operators import archetypes, cluster, describe, quality, trajectory
from trajecta.plans import observations as obs
from trajecta.plans.catalog import registered
from trajecta.plans.queries.trajectories import part_states, part_traits
from trajecta.session import materialise

KEYS = obs.KEYS
LABELS = Settings().labels

# Given centres in standardised units, so that everything after a fit has one right answer.
CENTRES = ((-1.3, 0.2), (-0.6, -0.8), (0.1, 1.1), (0.7, -0.4), (1.4, 0.3))

_CENTRE_ROWS = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(CENTRES, 1))

ASSIGNED = (
    obs.TRAJECTORY
    + f""",
centres(archetype, cx, cy) AS (VALUES {_CENTRE_ROWS}),
scale AS (
  SELECT AVG(peak_period) AS mx, stddev_pop(peak_period) AS sx,
         AVG(strong_width) AS my, stddev_pop(strong_width) AS sy FROM traits),
scaled AS (
  SELECT traits.*, (peak_period - mx) / sx AS zx, (strong_width - my) / sy AS zy
  FROM traits CROSS JOIN scale),
assigned AS (
  SELECT entity, grp, arg_min(archetype, (d, archetype)) AS archetype, MIN(d) AS distance
  FROM (SELECT entity, grp, archetype, sqrt((zx - cx) * (zx - cx) + (zy - cy) * (zy - cy)) AS d
        FROM scaled CROSS JOIN centres)
  GROUP BY 1, 2)"""
)


def _traits(spark: SparkSession, sf_dir: str, fact: DataFrame | None = None) -> DataFrame:
    return materialise(part_traits(spark, sf_dir, fact), "traits")


def _given_model(traits: DataFrame) -> cluster.Archetypes:
    points = cluster.weighted_points(traits)
    return cluster.Archetypes(cluster.fit_scale(points), CENTRES, 0.0)


def _fitted_model(traits: DataFrame) -> cluster.Archetypes:
    points = cluster.weighted_points(traits)
    return cluster.fit_archetypes(points, cluster.fit_scale(points))


@registered(
    "standardised_features",
    f"WITH {ASSIGNED} SELECT entity, grp, ROUND(zx, 9) AS zx, ROUND(zy, 9) AS zy FROM scaled",
)
def standardised_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    traits = _traits(spark, sf_dir)
    scaled = cluster.standardise(traits, cluster.fit_scale(cluster.weighted_points(traits)))
    return scaled.select(
        *KEYS, F.round("z_peak_period", 9).alias("zx"), F.round("z_strong_width", 9).alias("zy")
    )


@registered(
    "nearest_centre_assign",
    f"""WITH {ASSIGNED}
    SELECT entity, grp, archetype, ROUND(distance, 9) AS distance FROM assigned""",
)
def nearest_centre_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    traits = _traits(spark, sf_dir)
    assigned = cluster.assign(traits, _given_model(traits))
    return assigned.select(*KEYS, "archetype", F.round("distance", 9).alias("distance"))


PASSES = 3


def _lloyd_sql(passes: int) -> str:
    """One pair of common tables for each pass: who is nearest, and where the centres move."""
    steps = [f"m0 AS (SELECT archetype AS g, cx, cy FROM (VALUES {_CENTRE_ROWS}) AS c(archetype, cx, cy))"]
    for k in range(passes):
        steps.append(
            f"""n{k} AS (
      SELECT DISTINCT ON (entity, grp) entity, grp, zx, zy, g
      FROM scaled, m{k} ORDER BY entity, grp, (zx - cx) * (zx - cx) + (zy - cy) * (zy - cy), g),
    m{k + 1} AS (
      SELECT m.g, COALESCE(AVG(zx), any_value(cx)) AS cx, COALESCE(AVG(zy), any_value(cy)) AS cy
      FROM m{k} m LEFT JOIN n{k} n ON n.g = m.g GROUP BY m.g)"""
        )
    return ", ".join(steps)


@registered(
    "kmeans_given_starts",
    f"""WITH {ASSIGNED}, {_lloyd_sql(PASSES)},
    cost AS (
      SELECT SUM(d) AS cost
      FROM (SELECT MIN((zx - cx) * (zx - cx) + (zy - cy) * (zy - cy)) AS d
            FROM scaled, m{PASSES} GROUP BY entity, grp))
    SELECT row_number() OVER (ORDER BY cx, cy) AS archetype, ROUND(cx, 8) AS cx, ROUND(cy, 8) AS cy,
           ROUND(cost, 5) AS cost
    FROM m{PASSES}, cost""",
)
def kmeans_given_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres after three passes from given starts, numbered by epoch, and their cost."""
    points = cluster.weighted_points(_traits(spark, sf_dir))
    model = cluster.lloyd(points, cluster.fit_scale(points), CENTRES, PASSES)
    rows = [(k, x, y, model.cost) for k, (x, y) in enumerate(model.centres, 1)]
    return spark.createDataFrame(rows, "archetype long, cx double, cy double, cost double").select(
        "archetype", F.round("cx", 8).alias("cx"), F.round("cy", 8).alias("cy"), F.round("cost", 5).alias("cost")
    )


@registered("kmeans_archetypes")
def kmeans_archetypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted grouping: 20 starts, least cost, groups numbered by epoch."""
    traits = _traits(spark, sf_dir)
    return cluster.assign(traits, _fitted_model(traits)).select(*KEYS, "archetype", "distance")


@registered(
    "silhouette_weighted",
    f"""WITH {ASSIGNED},
    members AS (SELECT s.entity, s.grp, s.zx, s.zy, a.archetype
                FROM scaled s JOIN assigned a USING (entity, grp)),
    points AS (SELECT zx, zy, archetype, COUNT(*) AS weight FROM members GROUP BY 1, 2, 3),
    sizes AS (SELECT archetype AS other, SUM(weight) AS size FROM points GROUP BY 1),
    sums AS (
      SELECT p.zx, p.zy, p.archetype, p.weight, q.archetype AS other,
             SUM(q.weight * sqrt((p.zx - q.zx) * (p.zx - q.zx) + (p.zy - q.zy) * (p.zy - q.zy))) AS total
      FROM points p CROSS JOIN points q GROUP BY 1, 2, 3, 4, 5),
    scores AS (
      SELECT zx, zy, archetype, weight, MAX(size) FILTER (WHERE other = archetype) AS own,
             MAX(total / NULLIF(size - 1, 0)) FILTER (WHERE other = archetype) AS a,
             MIN(total / size) FILTER (WHERE other <> archetype) AS b
      FROM sums JOIN sizes USING (other) GROUP BY 1, 2, 3, 4)
    SELECT ROUND(SUM(weight * CASE WHEN own = 1 THEN 0 ELSE (b - a) / GREATEST(a, b) END)
                 / SUM(weight), 9) AS silhouette
    FROM scores""",
)
def silhouette_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    traits = _traits(spark, sf_dir)
    points = cluster.weighted_points(traits)
    model = cluster.Archetypes(cluster.fit_scale(points), CENTRES, 0.0)
    labelled = cluster.standardise(cluster.assign(points, model), model.scale)
    score = cluster.silhouette(labelled, ["z_peak_period", "z_strong_width"])
    return score.select(F.round("silhouette", 9).alias("silhouette"))


@registered(
    "adjusted_rand",
    """WITH t AS (SELECT l_linestatus AS status, l_returnflag AS a, l_linenumber AS b, COUNT(*) AS n
                FROM lineitem GROUP BY 1, 2, 3),
    both_ AS (SELECT status, SUM(n * (n - 1) / 2) AS s FROM t GROUP BY 1),
    a_ AS (SELECT status, SUM(n * (n - 1) / 2) AS s
           FROM (SELECT status, a, CAST(SUM(n) AS DOUBLE) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
    b_ AS (SELECT status, SUM(n * (n - 1) / 2) AS s
           FROM (SELECT status, b, CAST(SUM(n) AS DOUBLE) AS n FROM t GROUP BY 1, 2) GROUP BY 1),
    all_ AS (SELECT status, n * (n - 1) / 2 AS s
             FROM (SELECT status, CAST(SUM(n) AS DOUBLE) AS n FROM t GROUP BY 1))
    SELECT status, ROUND((both_.s - a_.s * b_.s / all_.s)
                         / ((a_.s + b_.s) / 2 - a_.s * b_.s / all_.s), 9) AS rand_index
    FROM both_ JOIN a_ USING (status) JOIN b_ USING (status) JOIN all_ USING (status)""",
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = obs.table(spark, sf_dir, "lineitem").withColumnRenamed("l_linestatus", "status")
    score = cluster.adjusted_rand(lines, "l_returnflag", "l_linenumber", by=["status"])
    return score.withColumn("rand_index", F.round("rand_index", 9))


@registered("stability_draws")
def stability_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the fitted grouping with a refit on each of 20 draws of 80 %."""
    traits = _traits(spark, sf_dir)
    return cluster.stability_by_draw(traits, _fitted_model(traits), KEYS)


DRAWS = 4


def _given_draws_sql() -> str:
    """Members of each draw by arithmetic, one pass of centres for each, and the pair counts."""
    return f"""
    members AS (
      SELECT s.entity, s.grp, s.zx, s.zy, d.draw FROM scaled s
      JOIN (SELECT unnest(range(1, {DRAWS + 1})) AS draw) d ON (s.entity * 7 + d.draw * 13) % 10 < 8),
    moved AS (
      SELECT draw, row_number() OVER (PARTITION BY draw ORDER BY cx, cy) AS trial, cx, cy FROM (
        SELECT d.draw, c.archetype, COALESCE(AVG(m.zx), any_value(c.cx)) AS cx, COALESCE(AVG(m.zy), any_value(c.cy)) AS cy
        FROM centres c CROSS JOIN (SELECT DISTINCT draw FROM members) d
        LEFT JOIN (SELECT m.*, a.archetype FROM members m JOIN assigned a USING (entity, grp)) m
          ON m.draw = d.draw AND m.archetype = c.archetype
        GROUP BY d.draw, c.archetype)),
    labelled AS (
      SELECT m.draw, m.entity, m.grp, a.archetype AS reference, t.trial
      FROM members m JOIN assigned a USING (entity, grp)
      JOIN (SELECT m.draw, m.entity, m.grp,
                   arg_min(v.trial, ((m.zx - v.cx) * (m.zx - v.cx) + (m.zy - v.cy) * (m.zy - v.cy), v.trial)) AS trial
            FROM members m JOIN moved v ON v.draw = m.draw GROUP BY 1, 2, 3) t
        ON t.draw = m.draw AND t.entity = m.entity AND t.grp = m.grp),
    cells2 AS (SELECT draw, reference, trial, CAST(COUNT(*) AS DOUBLE) AS n FROM labelled GROUP BY 1, 2, 3),
    both_ AS (SELECT draw, SUM(n * (n - 1) / 2) AS s, SUM(n) AS n FROM cells2 GROUP BY 1),
    a_ AS (SELECT draw, SUM(n * (n - 1) / 2) AS s FROM (SELECT draw, reference, SUM(n) AS n FROM cells2 GROUP BY 1, 2) GROUP BY 1),
    b_ AS (SELECT draw, SUM(n * (n - 1) / 2) AS s FROM (SELECT draw, trial, SUM(n) AS n FROM cells2 GROUP BY 1, 2) GROUP BY 1)
    SELECT draw, CAST(both_.n AS BIGINT) AS members,
           ROUND((both_.s - a_.s * b_.s / (both_.n * (both_.n - 1) / 2))
                 / ((a_.s + b_.s) / 2 - a_.s * b_.s / (both_.n * (both_.n - 1) / 2)), 9) AS rand_index
    FROM both_ JOIN a_ USING (draw) JOIN b_ USING (draw)"""


@registered("stability_given_draws", f"WITH {ASSIGNED},{_given_draws_sql()}")
def stability_given_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of given groups with a refit of one pass on each of four given draws of the parts."""
    traits = _traits(spark, sf_dir)
    model = _given_model(traits)
    bits = [
        F.when((F.col("entity") * 7 + d * 13) % 10 < 8, F.lit(1 << (d - 1))).otherwise(0).cast("long")
        for d in range(1, DRAWS + 1)
    ]
    rows = traits.withColumn("draws", reduce(Column.bitwiseOR, bits))
    weights = materialise(cluster.draw_weights(rows, list(model.scale.features), DRAWS), "draws")
    refits = [cluster.lloyd(weights.filter(F.col("draw") == d), model.scale, CENTRES, 1).centres for d in range(1, DRAWS + 1)]
    scores = cluster.agreement_by_draw(weights, model, refits)
    members = weights.groupBy("draw").agg(F.sum("weight").alias("members"))
    return scores.join(members, "draw").select(
        F.col("draw").cast("long").alias("draw"), "members", F.round("rand_index", 9).alias("rand_index")
    )


_FIT_CHECKS = (
    "centre is the mean of its members", "member is nearest to its centre", "groups numbered by epoch", "every part has a group",
)


@registered(
    "kmeans_fit_checks",
    " UNION ALL ".join(f"SELECT '{name}' AS \"check\", CAST(0 AS BIGINT) AS violations" for name in _FIT_CHECKS),
)
def kmeans_fit_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What any fit must hold, whichever local optimum its starts lead to: the fit stops when centres
    move by less than a hundredth of a standard deviation, so means agree to that."""
    traits = _traits(spark, sf_dir)
    model = _fitted_model(traits)
    axes = [f"z_{c}" for c in model.scale.features]
    labelled = cluster.standardise(cluster.assign(traits, model), model.scale)
    centres = spark.createDataFrame(
        [(k, *c) for k, c in enumerate(model.centres, 1)], f"archetype int, {', '.join(f'c_{a} double' for a in axes)}"
    )
    means = labelled.groupBy("archetype").agg(*[F.avg(a).alias(a) for a in axes])
    apart = sum((F.abs(F.col(a) - F.col(f"c_{a}")) > 0.02).cast("int") for a in axes)
    to_centre = [
        sum((F.col(a) - F.lit(float(v))) * (F.col(a) - F.lit(float(v))) for a, v in zip(axes, c)) for c in model.centres
    ]
    farther = F.col("distance") * F.col("distance") > F.array_min(F.array(*to_centre)) + 1e-9
    ordered = list(model.centres) == sorted(model.centres)
    return quality.report(
        [
            quality.over_keys(means.join(centres, "archetype"), **{_FIT_CHECKS[0].replace(" ", "_"): F.sum(apart)}),
            quality.row_checks(labelled, (_FIT_CHECKS[1], farther)),
            quality.known(spark, {_FIT_CHECKS[2]: not ordered}),
            quality.row_checks(labelled, (_FIT_CHECKS[3], F.col("archetype").isNull() | ~F.col("archetype").between(1, len(CENTRES)))),
        ]
    ).drop("passed")


@registered(
    "archetype_dim",
    f"""WITH {ASSIGNED},
    dim(archetype, label, classified) AS (
      VALUES (0, 'Non classé', false), (1, 'Groupe 1', true), (2, 'Groupe 2', true),
             (3, 'Groupe 3', true), (4, 'Groupe 4', true), (5, 'Groupe 5', true)),
    bridge AS (
      SELECT DISTINCT f.entity, f.grp, COALESCE(a.archetype, 0) AS archetype
      FROM fact f LEFT JOIN assigned a ON a.entity = f.entity AND a.grp = f.grp)
    SELECT archetype, label, classified, COUNT(b.entity) AS members
    FROM dim LEFT JOIN bridge b USING (archetype) GROUP BY 1, 2, 3""",
)
def archetype_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled groups and how many entities each one holds."""
    fact = obs.landed_fact(spark, sf_dir)
    members = _bridge(fact, _traits(spark, sf_dir, fact)).groupBy("archetype").agg(F.count("*").alias("members"))
    return (
        archetypes.archetype_dim(spark, LABELS)
        .join(members, "archetype", "left")
        .withColumn("members", F.coalesce("members", F.lit(0).cast("long")))
    )


@registered(
    "archetype_bridge",
    f"""WITH {ASSIGNED}
    SELECT DISTINCT f.entity, f.grp, COALESCE(a.archetype, 0) AS archetype,
           ROUND(a.distance, 9) AS distance
    FROM fact f LEFT JOIN assigned a ON a.entity = f.entity AND a.grp = f.grp""",
)
def archetype_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = obs.landed_fact(spark, sf_dir)
    return _bridge(fact, _traits(spark, sf_dir, fact)).withColumn("distance", F.round("distance", 9))


def _bridge(fact: DataFrame, traits: DataFrame) -> DataFrame:
    assigned = cluster.assign(traits, _given_model(traits))
    return archetypes.bridge(fact.select(*KEYS).distinct(), assigned, KEYS)


@registered(
    "group_mean_curve",
    f"""WITH {ASSIGNED}
    SELECT archetype, period, ROUND(AVG(smooth), 9) AS mean_share
    FROM profiles JOIN assigned USING (entity, grp) GROUP BY 1, 2""",
)
def group_mean_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The dense rows are made again for the curves, in the tasks of the grid: stored, they would be
    # shuffled and sorted for the join, several of them for each fact.
    fact = obs.landed_fact(spark, sf_dir)
    traits = _traits(spark, sf_dir, fact)
    states = part_states(spark, sf_dir, fact)
    curves = archetypes.mean_curve(states, cluster.assign(traits, _given_model(traits)), KEYS)
    return curves.withColumn("mean_share", F.round("mean_share", 9))


@registered(
    "group_composition",
    f"""WITH {ASSIGNED}
    SELECT archetype, 'Groupe ' || archetype AS label, COUNT(*) AS entities,
           MIN(peak_period) AS peak_min, MAX(peak_period) AS peak_max,
           COUNT(*) FILTER (WHERE ongoing) AS ongoing,
           ROUND(median(CAST(peak_period AS DOUBLE))) AS peak_period_median,
           ROUND(median(CAST(strong_width AS DOUBLE))) AS strong_width_median,
           ROUND(median(concentration), 2) AS concentration_median
    FROM traits JOIN assigned USING (entity, grp) GROUP BY archetype""",
)
def group_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = obs.landed_fact(spark, sf_dir)
    traits = _traits(spark, sf_dir, fact)
    groups = archetypes.archetype_dim(spark, LABELS)
    return describe.group_composition(_bridge(fact, traits), groups, traits, KEYS)


@registered(
    "group_representatives",
    f"""WITH {ASSIGNED},
    numbered AS (
      SELECT archetype, entity || '-' || grp AS segment,
             row_number() OVER (PARTITION BY archetype
                                ORDER BY ROUND(distance, 9), entity, grp) AS place
      FROM assigned)
    SELECT archetype, string_agg(segment, ', ' ORDER BY place) AS members
    FROM numbered WHERE place <= 6 GROUP BY archetype""",
)
def group_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances are rounded first: parts on the same point must tie exactly."""
    key = F.struct("entity", "grp")
    fact = obs.landed_fact(spark, sf_dir)
    bridge = _bridge(fact, _traits(spark, sf_dir, fact)).select(
        key.alias("entity_id"), "archetype", F.round("distance", 9).alias("distance")
    )
    entities = fact.select(*KEYS).distinct()
    name = F.concat(F.col("entity").cast("string"), F.lit("-"), "grp")
    dim = entities.select(key.alias("entity_id"), name.alias("segment"))
    return describe.representatives(bridge, dim)
