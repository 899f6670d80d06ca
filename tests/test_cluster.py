from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import cluster


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    centres = [(1910, 60), (1930, 20), (1955, 50), (1980, 15), (2010, 30)]
    rows = []
    for i in range(600):
        x, y = centres[i % 5]
        rows.append((i, int(x + rng.integers(-4, 5)), int(y + rng.integers(-4, 5)), i % 5 + 1))
    return spark.createDataFrame(
        rows, "entity_id bigint, peak_period int, strong_width bigint, truth int"
    ).cache()


@pytest.fixture(scope="module")
def model(blobs):
    points = cluster.weighted_points(blobs)
    return cluster.fit_archetypes(points, cluster.fit_scale(points), restarts=5)


def test_groups_are_found_and_numbered_by_epoch(blobs, model):
    assigned = cluster.assign(blobs, model)
    assert assigned.filter("archetype <> truth").count() == 0
    firsts = [c[0] for c in model.centres]
    assert firsts == sorted(firsts)


def test_fit_reaches_the_optimum_of_exact_centres(blobs, model):
    pdf = blobs.toPandas()
    z = pdf[["peak_period", "strong_width"]].to_numpy(float)
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    cost = sum(((z[pdf.truth == g] - z[pdf.truth == g].mean(axis=0)) ** 2).sum() for g in range(1, 6))
    assert model.cost == pytest.approx(cost, rel=1e-9)


def test_fit_is_repeatable(blobs, model):
    points = cluster.weighted_points(blobs.repartition(7))
    again = cluster.fit_archetypes(points, cluster.fit_scale(points), restarts=5)
    assert np.allclose(again.centres, model.centres)


def test_distance_is_euclidean_in_standard_units(blobs, model):
    row = cluster.assign(cluster.standardise(blobs, model.scale), model).first()
    centre = model.centres[row["archetype"] - 1]
    want = np.hypot(row["z_peak_period"] - centre[0], row["z_strong_width"] - centre[1])
    assert row["distance"] == pytest.approx(want, abs=1e-12)


def test_a_constant_feature_scales_by_one(spark):
    df = spark.createDataFrame([(5, i) for i in range(4)], "peak_period int, strong_width bigint")
    scale = cluster.fit_scale(cluster.weighted_points(df))
    assert scale.deviations[0] == 1.0
    assert scale.deviations[1] == pytest.approx(np.std(range(4)))


def _silhouette(z, labels):
    scores = []
    for i in range(len(z)):
        d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        own = labels == labels[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[own].sum() / (own.sum() - 1)
        b = min(d[labels == g].mean() for g in set(labels) if g != labels[i])
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [200_000, 50])
def test_silhouette_matches_brute_force(spark, block):
    rng = np.random.default_rng(5)
    z = rng.integers(0, 12, size=(150, 2)).astype(float)
    labels = rng.integers(1, 4, size=150)
    labels[0] = 9  # a group of one
    rows = [(float(x), float(y), int(g), 1) for (x, y), g in zip(z, labels)]
    df = spark.createDataFrame(rows, "x double, y double, archetype int, weight bigint")
    score = cluster.silhouette(df, ["x", "y"], block=block).first()["silhouette"]
    assert score == pytest.approx(_silhouette(z, labels), abs=1e-9)


def _rand(a, b):
    same = {"both": 0, "a": 0, "b": 0, "all": 0}
    for i, j in combinations(range(len(a)), 2):
        same["a"] += a[i] == a[j]
        same["b"] += b[i] == b[j]
        same["both"] += a[i] == a[j] and b[i] == b[j]
        same["all"] += 1
    expected = same["a"] * same["b"] / same["all"]
    return (same["both"] - expected) / ((same["a"] + same["b"]) / 2 - expected)


def test_adjusted_rand_matches_pair_counting(spark):
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 4, 120), rng.integers(0, 3, 120)
    b[:60] = a[:60] % 3
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a int, b int")
    assert cluster.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(_rand(a, b), abs=1e-12)
    assert cluster.adjusted_rand(df, "a", "a").first()[0] == 1.0
    assert cluster.adjusted_rand(df.withColumn("c", F.lit(1)), "c", "c").first()[0] == 1.0


def test_draws_have_the_exact_size_and_no_repeats(spark):
    df = spark.range(1003).withColumnRenamed("id", "entity_id")
    sample = cluster.draw_without_replacement(df, ["entity_id"], 0.8, draws=4).cache()
    sizes = {r["draw"]: (r["n"], r["d"]) for r in sample.groupBy("draw").agg(
        F.count("*").alias("n"), F.count_distinct("entity_id").alias("d")).collect()}
    assert sizes == {i: (802, 802) for i in range(1, 5)}
    again = cluster.draw_without_replacement(df.repartition(5), ["entity_id"], 0.8, draws=4)
    assert sample.exceptAll(again).count() == 0
    one, two = (set(r[0] for r in sample.filter(f"draw = {d}").select("entity_id").collect()) for d in (1, 2))
    assert one != two


@pytest.mark.parametrize("rows,fraction,draws", [(0, 0.8, 3), (1, 0.8, 2), (1, 1.0, 2), (7, 0.5, 63), (5000, 0.013, 5)])
def test_draws_are_bits_of_one_row(spark, rows, fraction, draws):
    df = spark.range(rows).withColumn("x", F.col("id") % 3)
    bits = cluster.drawn(df, ["id"], fraction, draws, seed=3)
    assert bits.count() == rows
    per_row = [r["draws"] for r in bits.collect()]
    assert [sum(b >> d & 1 for b in per_row) for d in range(draws)] == [int(fraction * rows)] * draws
    weights = cluster.draw_weights(bits, ["x"], draws).groupBy("draw").agg(F.sum("weight").alias("n")).collect()
    assert {r["draw"]: r["n"] for r in weights} == {d + 1: int(fraction * rows) for d in range(draws) if int(fraction * rows)}
    with pytest.raises(ValueError, match="63"):
        cluster.drawn(df, ["id"], fraction, 64)


def test_entities_are_never_copied_for_the_draws(spark, capsys):
    df = spark.range(100).withColumn("x", F.col("id") % 3)
    cluster.drawn(df, ["id"]).explain("formatted")
    assert "Generate" not in capsys.readouterr().out


def test_stability_of_separated_groups_is_one(blobs, model):
    scores = cluster.stability_by_draw(blobs, model, ["entity_id"], draws=3, restarts=4)
    row = cluster.stability(scores).first()
    assert row["draws"] == 3
    assert row["stability"] == pytest.approx(1.0, abs=1e-9)
