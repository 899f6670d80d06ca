"""Dense yearly or monthly profiles and the shape traits read from them.

Everything after ``series`` lives on one hash partitioning by entity: a single exchange
and a single sort serve densifying, smoothing, states and traits.  An entity has at most
one row per period, so no entity can be hot here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.numbers import at_most_one, clamp, ratio
from trajecta.session import dealt

ENTITY = ("entity_id",)

# Observed points of one task; the zeros of the dense grid make several rows of each.
TASK_POINTS = 125_000


def eligible(dim: DataFrame, threshold: int) -> DataFrame:
    """Entities with enough counts to have a trajectory at all."""
    return dim.filter(F.col("total") >= F.lit(threshold))


def series(fact: DataFrame, keys: Sequence[str] = ENTITY, top: int = 10) -> DataFrame:
    """One row per entity: its observed points, total, and the sum of its best periods."""
    points = fact.select(*keys, F.struct(F.col("period"), F.col("n").cast("long").alias("n")).alias("p"))
    gathered = points.groupBy(*keys).agg(
        F.collect_list("p").alias("points"), F.sum("p.n").alias("total")
    )
    ordered = F.sort_array(F.transform("points", lambda p: p.n), asc=False)
    best = F.aggregate(
        F.slice(ordered, 1, top), F.lit(0).cast("long"), lambda total, n: total + n
    )
    return gathered.withColumn("best", best)


def dense_grid(
    fact: DataFrame,
    periods: DataFrame,
    keys: Sequence[str] = ENTITY,
    threshold: int = 0,
    top: int = 10,
) -> DataFrame:
    """Every eligible entity × every known period, zeros included.

    ``fact`` must be at the grain (keys, period).  The missing periods are added inside
    each entity's own row, so neither a cross join nor a second shuffle is needed.  Tasks get a
    bounded number of points, whatever the size of the fact, as everything after this works on
    the unfolded rows of a task.
    """
    fact = dealt(fact, keys, TASK_POINTS)
    known = periods.agg(F.sort_array(F.collect_set("period"))).scalar()
    gathered = eligible(series(fact, keys, top), threshold).withColumn("known", known)
    seen = F.transform("points", lambda p: p.period)
    missing = F.transform(
        F.array_except("known", seen),
        lambda period: F.struct(period.alias("period"), F.lit(0).cast("long").alias("n")),
    )
    return gathered.select(*keys, "total", "best", F.inline(F.concat("points", missing)))


def profile(grid: DataFrame, keys: Sequence[str] = ENTITY, reach: int = 2) -> DataFrame:
    """Share, centred moving average and cumulative share of each entity's own total.

    Sums stay integers and are divided once: half-peak ties are common in counts, and an
    average of rounded shares would settle them by rounding noise.

    The neighbours of a row are looked up one by one: a sliding frame would sum the whole frame
    again, from copies of its rows, for each.  All windows are taken in one pass over the rows.
    """
    in_order = Window.partitionBy(*keys).orderBy("period")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("total")
    names = [f"_near{i}" for i in range(2 * reach)]
    steps = [k for k in range(-reach, reach + 1) if k]
    looked_up = {name: F.lag("n", -k).over(in_order) for name, k in zip(names, steps)}
    near = [F.col(c) for c in ("n", *names)]
    around = reduce(add, [F.coalesce(c, F.lit(0).cast("long")) for c in near])
    counted = reduce(add, [F.when(c.isNotNull(), 1).otherwise(0) for c in near])
    return (
        grid.withColumns({**looked_up, "_so_far": F.sum("n").over(so_far)})
        .withColumns(
            {
                "share": ratio(F.col("n"), total),
                "smooth": ratio(around, counted * total),
                "cumulative": ratio(F.col("_so_far"), total),
            }
        )
        .drop("_so_far", *names)
    )


def peaks(profiles: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Height and earliest period of the maximum of the smoothed curve."""
    return profiles.groupBy(*keys).agg(
        F.max("smooth").alias("peak_height"),
        F.max_by("period", F.struct("smooth", (-F.col("period")).alias("early"))).alias("peak_period"),
    )


def with_peak_height(profiles: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """The height of the peak on every row of the entity, without joining an aggregate back."""
    return profiles.withColumn("peak_height", F.max("smooth").over(Window.partitionBy(*keys)))


def states(
    profiles: DataFrame, keys: Sequence[str] = ENTITY, enter: float = 0.50, leave: float = 0.35
) -> DataFrame:
    """Two-threshold hysteresis: 1 from ``enter`` of the peak, 0 below ``leave`` of it.

    Between the two the last decided state holds; before any decision it is null.
    ``previous`` is the state one period earlier, 0 when there is none.
    """
    in_order = Window.partitionBy(*keys).orderBy("period")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    raw = F.when(F.col("smooth") >= F.lit(enter) * F.col("peak_height"), 1).when(
        F.col("smooth") < F.lit(leave) * F.col("peak_height"), 0
    )
    return (
        with_peak_height(profiles, keys)
        .withColumn("raw_state", raw)
        # The last decision before a row is both what an undecided row holds on to and the
        # state of the row before it, so one window gives the two.
        .withColumn("_held", F.last("raw_state", ignorenulls=True).over(earlier))
        .withColumn("state", F.coalesce("raw_state", "_held"))
        .withColumn("previous", F.coalesce("_held", F.lit(0)))
        .drop("_held")
    )


def rank_periods(grid: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """``place`` of each period by count within its entity, earliest first on ties."""
    best_first = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "period")
    return grid.withColumn("place", F.row_number().over(best_first))


def traits(
    stated: DataFrame,
    keys: Sequence[str] = ENTITY,
    *,
    pivot: int = 2000,
    vintage: int = 2025,
    low: float = 0.05,
    high: float = 0.95,
    tail: int = 9,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row of shape traits per entity, and aggregates of its rows that are named in ``also``.

    Null rules are part of the result: a missing recency sum and an undefined asymmetry
    both become 1, because the clamps skip nulls.
    """
    strong = F.col("state") == 1
    also = also or {}
    measured = stated.groupBy(*keys).agg(
        F.min(F.when(F.col("smooth") == F.col("peak_height"), F.col("period"))).alias("peak_period"),
        F.count_if(strong).alias("strong_width"),
        F.count_if(strong & (F.col("previous") == 0)).alias("strong_runs"),
        F.any_value("best").alias("best"),
        F.any_value("total").alias("total"),
        F.sum(F.when(F.col("period") >= F.lit(pivot), F.col("n"))).alias("recent"),
        F.min(F.when(F.col("cumulative") >= F.lit(low), F.col("period"))).alias("start_period"),
        F.max(F.when(F.col("cumulative") <= F.lit(high), F.col("period"))).alias("end_period"),
        *[value.alias(name) for name, value in also.items()],
    )
    climb = F.col("peak_period") - F.col("start_period")
    span = F.col("end_period") - F.col("start_period")
    return measured.select(
        *keys,
        "peak_period",
        "strong_width",
        "strong_runs",
        at_most_one(ratio(F.col("best"), F.col("total"))).alias("concentration"),
        at_most_one(ratio(F.col("recent"), F.col("total"))).alias("recency"),
        "start_period",
        "end_period",
        clamp(ratio(climb, span)).alias("asymmetry"),
        (F.col("peak_period") >= F.lit(vintage - tail)).alias("ongoing"),
        *also,
    )


def shape_traits(
    fact: DataFrame,
    periods: DataFrame,
    keys: Sequence[str] = ENTITY,
    *,
    threshold: int = 0,
    top: int = 10,
    **options: float,
) -> DataFrame:
    """From sparse facts to traits in one plan."""
    grid = dense_grid(fact, periods, keys, threshold, top)
    return traits(states(profile(grid, keys), keys), keys, **options)
