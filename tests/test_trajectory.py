"""Shape traits on hand-made series of ten periods, 2016 to 2025."""

import pytest
from pyspark.sql import functions as F

from trajecta.operators import trajectory

FIRST = 2016
SERIES = {
    "E1": [100, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    "E2": [0, 0, 0, 0, 0, 0, 0, 0, 0, 100],
    "E3": [0, 0, 0, 0, 100, 0, 0, 0, 0, 0],
    "E4": [10] * 10,
    "E5": [50, 50, 50, 0, 0, 0, 0, 50, 50, 50],
    "E6": [0, 0, 100, 100, 100, 40, 40, 40, 40, 100],
    "E7": [40, 40, 40, 40, 40, 100, 100, 100, 100, 100],
    "E8": [5, None, 10, None, 40, 60, None, 20, 5, None],
}
# states, peak, width, runs, top 3, from 2021, start, end, asymmetry
EXPECTED = {
    "E1": ("1110000000", 2016, 3, 1, 1, 0, 2016, None, 1),
    "E2": ("0000000111", 2025, 3, 1, 1, 1, 2025, 2024, 0),
    "E3": ("0011111000", 2018, 5, 1, 1, 0, 2020, 2019, 1),
    "E4": ("1111111111", 2016, 10, 1, 0.3, 0.5, 2016, 2024, 0),
    "E5": ("1111000111", 2016, 7, 2, 0.5, 0.5, 2016, 2024, 0),
    "E6": ("-111111111", 2020, 9, 1, 300 / 560, 260 / 560, 2018, 2024, 2 / 6),
    "E7": ("---1111111", 2023, 7, 1, 300 / 700, 500 / 700, 2016, 2024, 7 / 8),
    "E8": ("0001111100", 2022, 5, 1, 120 / 140, 85 / 140, 2018, 2022, 1),
}
KEYS = ["entity"]


@pytest.fixture(scope="module")
def states(spark):
    rows = [
        (name, FIRST + i, n)
        for name, counts in SERIES.items()
        for i, n in enumerate(counts)
        if n is not None
    ]
    fact = spark.createDataFrame(rows, "entity string, period smallint, n bigint")
    periods = fact.select("period").distinct()
    grid = trajectory.dense_grid(fact, periods, KEYS, top=3)
    return trajectory.states(trajectory.profile(grid, KEYS), KEYS).cache()


@pytest.fixture(scope="module")
def traits(states):
    found = trajectory.traits(states, KEYS, pivot=2021, vintage=2025).collect()
    return {r["entity"]: r for r in found}


@pytest.mark.parametrize("case", sorted(SERIES))
def test_states(states, case):
    rows = states.filter(F.col("entity") == case).orderBy("period").collect()
    assert len(rows) == 10
    assert "".join("-" if r["state"] is None else str(r["state"]) for r in rows) == EXPECTED[case][0]


@pytest.mark.parametrize("case", sorted(SERIES))
def test_traits(traits, case):
    row, want = traits[case], EXPECTED[case]
    assert (row["peak_period"], row["strong_width"], row["strong_runs"]) == want[1:4]
    assert row["concentration"] == pytest.approx(want[4], abs=1e-12)
    assert row["recency"] == pytest.approx(want[5], abs=1e-12)
    assert (row["start_period"], row["end_period"]) == want[6:8]
    assert row["asymmetry"] == pytest.approx(want[8], abs=1e-12)
    assert row["ongoing"] == (want[1] >= 2016)


def test_recency_is_one_when_the_grid_ends_before_the_pivot(states):
    early = trajectory.traits(states, KEYS, pivot=2100, vintage=2025)
    assert {r["recency"] for r in early.collect()} == {1.0}


def test_grid_keeps_only_observed_periods_and_eligible_entities(spark):
    fact = spark.createDataFrame(
        [("a", 1, 10), ("a", 5, 10), ("b", 3, 4)], "entity string, period int, n bigint"
    )
    grid = trajectory.dense_grid(fact, fact.select("period").distinct(), KEYS, threshold=20)
    rows = sorted((r["entity"], r["period"], r["n"]) for r in grid.collect())
    assert rows == [("a", 1, 10), ("a", 3, 0), ("a", 5, 10)]


def test_profile_needs_one_exchange_and_no_join(spark, capsys):
    fact = spark.range(1000).selectExpr("id % 50 AS entity", "int(id % 7) AS period", "id AS n")
    grid = trajectory.dense_grid(fact, fact.select("period").distinct(), KEYS)
    plan = trajectory.traits(trajectory.states(trajectory.profile(grid, KEYS), KEYS), KEYS)
    plan.explain("formatted")
    main = capsys.readouterr().out.split("===== Subqueries =====")[0]
    assert main.count("hashpartitioning(entity") == 1
    assert "Join" not in main and "SinglePartition" not in main


def test_a_task_gets_a_bounded_number_of_points(spark, monkeypatch):
    """More points make more tasks, not larger ones, also where the planner would merge them."""
    monkeypatch.setattr(trajectory, "TASK_POINTS", 100)
    for points in (4000, 8000):
        fact = spark.range(points).selectExpr("id DIV 7 AS entity", "int(id % 7) AS period", "id AS n")
        periods = fact.select("period").distinct()
        profiles = trajectory.profile(trajectory.dense_grid(fact, periods, KEYS), KEYS)
        tasks = profiles.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > points / 200 and max(r["count"] for r in tasks) < 400


def test_traits_take_other_aggregates_along(spark):
    fact = spark.range(70).selectExpr("id % 10 AS entity", "int(id DIV 10) AS period", "id + 1 AS n")
    grid = trajectory.dense_grid(fact, fact.select("period").distinct(), KEYS)
    states = trajectory.states(trajectory.profile(grid, KEYS), KEYS)
    found = trajectory.traits(states, KEYS, also={"rows": F.count(F.lit(1)), "shares": F.sum("share")})
    assert found.drop("rows", "shares").columns == trajectory.traits(states, KEYS).columns
    assert {(r["rows"], round(r["shares"], 9)) for r in found.collect()} == {(7, 1.0)}


def test_periods_are_ranked_by_count_then_age(spark):
    fact = spark.createDataFrame(
        [("a", 1, 5), ("a", 2, 9), ("a", 3, 5)], "entity string, period int, n bigint"
    )
    places = {r["period"]: r["place"] for r in trajectory.rank_periods(fact, KEYS).collect()}
    assert places == {2: 1, 1: 2, 3: 3}


def test_peak_takes_the_earliest_on_a_tie(spark):
    rows = [("a", 3, 0.5), ("a", 1, 0.5), ("a", 2, 0.4)]
    profiles = spark.createDataFrame(rows, "entity string, period int, smooth double")
    assert trajectory.peaks(profiles, KEYS).first()["peak_period"] == 1


def test_a_profile_takes_its_windows_in_one_pass_without_a_sliding_frame(spark, capsys):
    counts = {1: [3, 0, None, 5, 2, 7], 2: [None, None, None, None], 3: [4]}
    rows = [(e, p, n, 10) for e, ns in counts.items() for p, n in enumerate(ns)]
    grid = spark.createDataFrame(rows, "entity_id int, period int, n long, total long")
    for reach in (1, 2):
        found = trajectory.profile(grid, reach=reach)
        found.explain("formatted")
        plan = capsys.readouterr().out
        assert plan.count("+- Window") == 1 and f"RowFrame, -{reach}, {reach})" not in plan
        assert found.columns == ["entity_id", "period", "n", "total", "share", "smooth", "cumulative"]
        for row in found.collect():
            ns = counts[row["entity_id"]]
            at = row["period"]
            near = [n for n in ns[max(0, at - reach) : at + reach + 1] if n is not None]
            before = [n for n in ns[: at + 1] if n is not None]
            assert row["smooth"] == (sum(near) / (len(near) * 10) if near else None)
            assert row["cumulative"] == (sum(before) / 10 if before else None)
