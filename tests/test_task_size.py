"""Sums of the part fact, and the curves, are made in tasks of a bounded size."""

import pytest
from pyspark.sql import functions as F

from trajecta import session
from trajecta.plans import observations
from trajecta.plans.queries import clusters

SETTINGS = (
    "spark.sql.shuffle.partitions",
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes",
)


@pytest.fixture()
def lines(spark, tmp_path):
    """Four hundred lines of twenty parts, in both states and ten months."""
    spark.range(400).select(
        (F.col("id") % 20).alias("l_partkey"),
        F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
        F.make_date(F.lit(1997), (F.col("id") % 10 + 1).cast("int"), F.lit(1)).cast("timestamp").alias("l_shipdate"),
        (F.col("id") + 1).cast("double").alias("l_quantity"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def _settings(spark):
    return [spark.conf.get(name) for name in SETTINGS]


def test_more_lines_make_more_partitions_and_settings_come_back(spark):
    before = _settings(spark)
    with pytest.raises(ZeroDivisionError), session.small_tasks(spark, 100_000, 100):
        assert spark.conf.get(SETTINGS[0]) == "1000"
        assert spark.conf.get(SETTINGS[1]) == f"{16 << 20}b"
        raise ZeroDivisionError
    assert _settings(spark) == before
    with session.small_tasks(spark, 1, 100):
        assert spark.conf.get(SETTINGS[0]) == before[0]


def test_the_fact_is_written_in_small_tasks(spark, lines, monkeypatch):
    monkeypatch.setattr(observations, "FACT_TASK_ROWS", 4)
    seen, before = [], _settings(spark)

    def materialise(df, label):
        seen.append(spark.conf.get(SETTINGS[0]))
        return session.materialise(df, label)

    monkeypatch.setattr(observations, "materialise", materialise)
    found = observations.landed_fact(spark, lines)
    assert seen == ["100"] and _settings(spark) == before
    sums = found.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    assert tuple(sums) == (20, 400 * 401 // 2)


def test_dense_rows_of_the_curves_are_neither_stored_nor_shuffled(spark, lines, monkeypatch, capsys):
    monkeypatch.setattr(observations, "THRESHOLD", 1)
    clusters.group_mean_curve(spark, lines).explain("formatted")
    plan = capsys.readouterr().out.split("===== Subqueries =====")[0]
    shuffled = [line for line in plan.splitlines() if "hashpartitioning(entity" in line]
    assert len(shuffled) <= 2 and "states-" not in plan
