import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators.keys import dense_key
from trajecta.operators.quantiles import exact_quantiles


def test_dense_key_equals_a_global_row_number(spark):
    rng = random.Random(1)
    # A third of the keys share one prefix: ranges must still be even.
    names = {"HOT" + str(rng.random()) for _ in range(2000)} | {str(rng.random()) for _ in range(4000)}
    rows = [(n, g) for n in names for g in ("a", "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "entity string, grp string").repartition(13)
    numbered = dense_key(df, ["entity", "grp"]).collect()
    want = {key: i for i, key in enumerate(sorted(rows), start=1)}
    assert {(r["entity"], r["grp"]): r["entity_id"] for r in numbered} == want


def test_dense_key_of_nothing(spark):
    assert dense_key(spark.range(0).withColumnRenamed("id", "entity"), ["entity"]).count() == 0


def test_dense_key_puts_nulls_first(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "entity string")
    assert {r["entity"]: r["entity_id"] for r in dense_key(df, ["entity"]).collect()} == {
        None: 1, "a": 2, "b": 3,
    }


@pytest.mark.parametrize("size", [1, 2, 7, 5000])
def test_quantiles_match_linear_interpolation(spark, size):
    rng = np.random.default_rng(size)
    # Half of one group holds a single value.
    values = np.round(rng.normal(size=size), 3)
    values[: size // 2] = 0.25
    rows = [("a", float(v)) for v in values] + [("b", float(-v)) for v in values] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    found = {r["g"]: r for r in exact_quantiles(df, "v", points, ["g"]).collect()}
    for name, sign in (("a", 1), ("b", -1)):
        for column, p in points.items():
            assert found[name][column] == pytest.approx(np.quantile(sign * values, p), abs=1e-12)


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(101).select(F.col("id").cast("int").alias("v"))
    assert exact_quantiles(df, "v", {"median": 0.5}).first()["median"] == 50.0
    assert exact_quantiles(df.filter("v < 0"), "v", {"median": 0.5}).count() == 0
