"""Random series against the rules written out plainly in Python with exact fractions."""

from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trajecta.operators import trajectory

KEYS = ["entity"]
PERIODS = list(range(1990, 2004))
PIVOT, VINTAGE, TOP = 2000, 2003, 3


def plain_traits(points: dict[int, int], periods: list[int]) -> dict:
    n = [points.get(p, 0) for p in periods]
    total = sum(n)
    smooth = []
    for i in range(len(n)):
        near = n[max(0, i - 2) : i + 3]
        smooth.append(Fraction(sum(near), len(near) * total))
    height = max(smooth)
    peak = periods[smooth.index(height)]
    states, held = [], None
    for value in smooth:
        # The two thresholds are the doubles 0.5 and 0.35 times the rounded height.
        if float(value) >= 0.5 * float(height):
            held = 1
        elif float(value) < 0.35 * float(height):
            held = 0
        states.append(held)
    runs = sum(s == 1 and (i == 0 or states[i - 1] != 1) for i, s in enumerate(states))
    cumulative = [sum(n[: i + 1]) / total for i in range(len(n))]
    start = min(p for p, c in zip(periods, cumulative) if c >= 0.05)
    ends = [p for p, c in zip(periods, cumulative) if c <= 0.95]
    end = max(ends) if ends else None
    if end is None or end == start:
        asymmetry = 1.0
    else:
        asymmetry = max(0.0, min(1.0, (peak - start) / (end - start)))
    recent = [c for p, c in zip(periods, n) if p >= PIVOT]
    return {
        "peak_period": peak,
        "strong_width": states.count(1),
        "strong_runs": runs,
        "concentration": sum(sorted(n, reverse=True)[:TOP]) / total,
        "recency": sum(recent) / total if recent else 1.0,
        "start_period": start,
        "end_period": end,
        "asymmetry": asymmetry,
        "ongoing": peak >= VINTAGE - 9,
    }


series = st.dictionaries(st.sampled_from(PERIODS), st.integers(1, 12), min_size=1, max_size=len(PERIODS))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(series, min_size=30, max_size=60))
def test_traits_follow_the_rules(spark, many):
    rows = [(i, p, n) for i, points in enumerate(many) for p, n in points.items()]
    fact = spark.createDataFrame(rows, "entity int, period smallint, n bigint")
    found = trajectory.shape_traits(
        fact, fact.select("period").distinct(), KEYS, top=TOP, pivot=PIVOT, vintage=VINTAGE
    )
    periods = sorted({p for points in many for p in points})
    got = {r["entity"]: r.asDict() for r in found.collect()}
    assert len(got) == len(many)
    for i, points in enumerate(many):
        want = plain_traits(points, periods)
        for name, value in want.items():
            if isinstance(value, float):
                assert abs(got[i][name] - value) < 1e-12, (name, points)
            else:
                assert got[i][name] == value, (name, points)
