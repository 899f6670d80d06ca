"""K-means archetypes with separation and reproducibility scores.

The two features are integers bounded by the number of periods, so any number of entities
collapses to at most periods² weighted points.  Fits run on those; entities are only
touched by projections.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.functions.numbers import ratio
from trajecta.session import materialise

# Tasks get the functions of this module with the closure: it need not be installed there.
register_pickle_by_value(sys.modules[__name__])

FEATURES = ("peak_period", "strong_width")

# Distances one task computes at a time, however many points there are.
_TASK_DISTANCES = 4_000_000


@dataclass(frozen=True)
class Scale:
    """Mean and population standard deviation of each feature; a constant one scales by 1."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def columns(self) -> list[Column]:
        return [
            (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.features, self.means, self.deviations)
        ]


@dataclass(frozen=True)
class Archetypes:
    """Fitted centres in standardised units, ordered by their first feature; group 1 first."""

    scale: Scale
    centres: tuple[tuple[float, ...], ...]
    cost: float


def weighted_points(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Distinct feature combinations and how many entities share each."""
    return materialise(df.groupBy(*features).agg(F.count("*").alias("weight")), "points")


def fit_scale(points: DataFrame, features: Sequence[str] = FEATURES) -> Scale:
    """Weighted mean and population deviation, centred before squaring."""
    weight = F.col("weight")
    total = F.sum(weight)
    means = points.agg(*[(F.sum(weight * F.col(c)) / total).alias(c) for c in features]).first()
    spread = points.agg(
        *[
            F.sqrt(F.sum(weight * F.pow(F.col(c) - F.lit(means[c]), 2)) / total).alias(c)
            for c in features
        ]
    ).first()
    return Scale(
        tuple(features),
        tuple(float(means[c]) for c in features),
        tuple(float(spread[c]) or 1.0 for c in features),
    )


def standardise(df: DataFrame, scale: Scale) -> DataFrame:
    """Add ``z_<feature>`` columns."""
    return df.withColumns({f"z_{c}": z for c, z in zip(scale.features, scale.columns())})


def _uniform(points: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Repeatable uniforms in (0, 1) per (point hash, salt), the same on any executor."""
    with np.errstate(over="ignore"):
        mixed = points.astype(np.uint64)[:, None] ^ salts[None, :]
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(31)
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _squared(here: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, shaped (points, runs, centres)."""
    return ((here[:, None, None, :] - centres[None, :, :, :]) ** 2).sum(axis=3)


def _next_centres(points: DataFrame, axes: list[str], runs: dict[int, np.ndarray], step: int,
                  seed: int) -> dict[int, np.ndarray]:
    """One more starting centre for each run: a point drawn with odds weight × distance².

    Each task keeps its best candidate per run (smallest −ln u / odds); the smallest of
    those wins, which is a weighted draw without looking at all points in one place.
    """
    shared = points.sparkSession.sparkContext.broadcast(runs)

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for draw, part in batch.groupby("draw"):
                centres = shared.value[draw]
                here = part[axes].to_numpy(float)
                odds = part["weight"].to_numpy(float)[:, None]
                if step:
                    odds = odds * _squared(here, centres).min(axis=2)
                entropy = np.random.SeedSequence([seed, int(draw), step])
                salts = entropy.generate_state(len(centres), np.uint64)
                with np.errstate(divide="ignore"):
                    keys = -np.log(_uniform(part["point"].to_numpy(), salts)) / odds
                best = keys.argmin(axis=0)
                chosen = pd.DataFrame(here[best], columns=axes)
                yield chosen.assign(draw=draw, run=range(len(best)), odds=keys.min(axis=0))[
                    ["draw", "run", "odds", *axes]
                ]

    fields = ", ".join(f"{a} double" for a in axes)
    best = (
        points.mapInPandas(candidates, f"draw int, run int, odds double, {fields}")
        .groupBy("draw", "run")
        .agg(F.min_by(F.array(*axes), F.struct("odds", *axes)).alias("centre"))
        .collect()
    )
    grown = {}
    for draw, centres in runs.items():
        added = np.array([r["centre"] for r in sorted(best) if r["draw"] == draw])
        grown[draw] = np.concatenate([centres, added[:, None, :]], axis=1)
    return grown


def _cluster_sums(points: DataFrame, axes: list[str],
                  runs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per run and centre: weight, weighted coordinate sums and squared cost of its points."""
    shared = points.sparkSession.sparkContext.broadcast(runs)
    values = ["weight", *axes, "cost"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for draw, part in batch.groupby("draw"):
                centres = shared.value.get(draw)
                if centres is None:
                    continue
                here, weight = part[axes].to_numpy(float), part["weight"].to_numpy(float)
                squared = _squared(here, centres)
                near = squared.argmin(axis=2)
                count, k = centres.shape[:2]
                slot = (near + np.arange(count)[None, :] * k).ravel()

                def total(amount: np.ndarray) -> np.ndarray:
                    return np.bincount(slot, np.repeat(amount, count), count * k)

                out = pd.DataFrame({"draw": draw, "slot": np.arange(count * k)})
                out["weight"] = total(weight)
                for i, axis in enumerate(axes):
                    out[axis] = total(weight * here[:, i])
                least = squared.min(axis=2) * weight[:, None]
                out["cost"] = np.bincount(slot, least.ravel(), count * k)
                yield out

    fields = ", ".join(f"{v} double" for v in values)
    rows = (
        points.mapInPandas(sums, f"draw int, slot int, {fields}")
        .groupBy("draw", "slot")
        .agg(*[F.sum(v).alias(v) for v in values])
        .collect()
    )
    result = {d: np.zeros((c.shape[0] * c.shape[1], len(values))) for d, c in runs.items()}
    for row in rows:
        result[row["draw"]][row["slot"]] = [row[v] for v in values]
    return {d: result[d].reshape(*c.shape[:2], len(values)) for d, c in runs.items()}


def fit_many(points: DataFrame, scale: Scale, groups: int, restarts: int, seed: int,
             max_passes: int = 300) -> dict[int, Archetypes]:
    """Weighted k-means on every ``draw`` of ``points``, the cheapest of ``restarts`` runs each.

    All runs of all draws advance together, so the data is read once per iteration and not
    once per iteration of every run: 20 draws × 20 starts take as many passes as one fit.
    Only centres (draws × restarts × groups rows) come back to the driver.
    """
    axes = [f"z_{c}" for c in scale.features]
    prepared = standardise(points, scale).select(
        "draw", *axes, "weight", F.xxhash64(*scale.features).alias("point")
    )
    draws = {r["draw"]: r["n"] for r in prepared.groupBy("draw").agg(F.count("*").alias("n")).collect()}
    tasks = max(1, ceil(sum(draws.values()) * restarts * groups / _TASK_DISTANCES))
    prepared = prepared.repartition(tasks, "point", "draw").persist()
    # Stop when the centres of a run together move by less than 0.01 standard deviations.
    tolerance = 0.01
    try:
        runs = {d: np.empty((restarts, 0, len(axes))) for d in draws}
        for step in range(groups):
            runs = _next_centres(prepared, axes, runs, step, seed)
        costs = {d: np.full(restarts, np.inf) for d in draws}
        active = {d: np.arange(restarts) for d in draws}
        for _ in range(max_passes):
            measured = _cluster_sums(prepared, axes, {d: runs[d][a] for d, a in active.items()})
            for draw, found in measured.items():
                at = active[draw]
                weight = found[:, :, :1]
                with np.errstate(invalid="ignore", divide="ignore"):
                    moved = np.where(weight > 0, found[:, :, 1:-1] / weight, runs[draw][at])
                shift = np.sqrt(((moved - runs[draw][at]) ** 2).sum(axis=(1, 2)))
                runs[draw][at] = moved
                active[draw] = at[shift > tolerance]
            active = {d: a for d, a in active.items() if len(a)}
            if not active:
                break
        # The centres have moved since their costs were measured.
        for draw, found in _cluster_sums(prepared, axes, runs).items():
            costs[draw] = found[:, :, -1].sum(axis=1)
    finally:
        prepared.unpersist()
    models = {}
    for draw in draws:
        best = int(costs[draw].argmin())
        centres = sorted(tuple(float(v) for v in centre) for centre in runs[draw][best])
        models[draw] = Archetypes(scale, tuple(centres), float(costs[draw][best]))
    return models


def lloyd(points: DataFrame, scale: Scale, starts: Sequence[Sequence[float]], passes: int) -> Archetypes:
    """Weighted k-means from given starting centres, a given number of passes.

    A centre without points stays.  Groups are numbered by the order of the final centres.
    """
    axes = [f"z_{c}" for c in scale.features]
    prepared = standardise(points, scale).select(F.lit(0).alias("draw"), *axes, "weight")
    centres = np.array([starts], float)
    for _ in range(passes):
        found = _cluster_sums(prepared, axes, {0: centres})[0]
        weight = found[:, :, :1]
        with np.errstate(invalid="ignore", divide="ignore"):
            centres = np.where(weight > 0, found[:, :, 1:-1] / weight, centres)
    cost = float(_cluster_sums(prepared, axes, {0: centres})[0][:, :, -1].sum())
    return Archetypes(scale, tuple(sorted(tuple(float(v) for v in c) for c in centres[0])), cost)


def fit_archetypes(points: DataFrame, scale: Scale, groups: int = 5, restarts: int = 20,
                   seed: int = 0) -> Archetypes:
    """The cheapest of ``restarts`` weighted k-means fits, groups numbered by epoch."""
    return fit_many(points.withColumn("draw", F.lit(0)), scale, groups, restarts, seed)[0]


def _nearest(z: Sequence[Column], centres: Sequence[Sequence[float]]) -> Column:
    """Struct (squared distance, group); the lowest group wins an exact tie."""
    options = []
    for group, centre in enumerate(centres, start=1):
        squared = reduce(
            lambda a, b: a + b, [(c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(z, centre)]
        )
        options.append(F.struct(squared.alias("squared"), F.lit(group).alias("archetype")))
    return F.array_min(F.array(*options))


def assign(df: DataFrame, model: Archetypes) -> DataFrame:
    """Group and Euclidean distance to its centre, as a projection without any shuffle."""
    return (
        df.withColumn("_near", _nearest(model.scale.columns(), model.centres))
        .withColumn("archetype", F.col("_near.archetype"))
        .withColumn("distance", F.sqrt(F.col("_near.squared")))
        .drop("_near")
    )


def _distance_sums(mine: pd.DataFrame, theirs: pd.DataFrame, axes: list[str], group: str) -> pd.DataFrame:
    """For each point of one block and each group, the weighted sum of distances to the points
    of the other block."""
    names, owner = np.unique(theirs[group].to_numpy(), return_inverse=True)
    mass = np.zeros((len(theirs), len(names)))
    mass[np.arange(len(theirs)), owner] = theirs["weight"].to_numpy(float)
    here, others = mine[axes].to_numpy(float), theirs[axes].to_numpy(float)
    # A few rows at a time keep the distances small whatever the block.
    sums = np.concatenate(
        [
            np.sqrt(((here[i : i + 32, None, :] - others[None, :, :]) ** 2).sum(axis=2)) @ mass
            for i in range(0, len(here), 32)
        ]
    )
    columns = ["point", group, "weight", "other", "total"]
    return pd.concat([mine[columns[:3]].assign(other=n, total=sums[:, j])[columns] for j, n in enumerate(names)])


def silhouette(points: DataFrame, axes: Sequence[str], group: str = "archetype",
               block: int = 20_000) -> DataFrame:
    """Mean Euclidean silhouette of weighted points (``axes``, ``group``, ``weight``).

    Distances are needed between all points.  The distinct ones are dealt into blocks of at
    most ``block`` and each task gets one pair of blocks, so pairs of points are never built as
    rows, no point reaches the driver, and a task's memory does not depend on their number.
    """
    axes = list(axes)
    merged = points.groupBy(*axes, group).agg(F.sum("weight").cast("long").alias("weight"))
    stored = materialise(merged.withColumn("point", F.xxhash64(*axes, group)), "silhouette")
    # A task handles a few million distances.
    parts = max(1, ceil(stored.count() / min(block, int(_TASK_DISTANCES**0.5))))
    own_block = F.pmod(F.xxhash64("point"), F.lit(parts)).cast("int")
    all_blocks = F.explode(F.expr(f"sequence(0, {parts - 1})"))
    mine = stored.withColumn("mine", own_block).withColumn("theirs", all_blocks)
    theirs = stored.withColumn("theirs", own_block).withColumn("mine", all_blocks)
    kind = points.schema[group].dataType.simpleString()

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("point", group, "weight", "other", "total")})
        return _distance_sums(left, right, axes, group)

    sums = (
        mine.groupBy("mine", "theirs")
        .cogroup(theirs.groupBy("mine", "theirs"))
        .applyInPandas(measure, f"point bigint, {group} {kind}, weight bigint, other {kind}, total double")
    )
    sizes = stored.groupBy(F.col(group).alias("other")).agg(F.sum("weight").alias("size"))
    own = F.col(group) == F.col("other")
    scored = (
        sums.join(materialise(sizes, "sizes"), "other")
        .groupBy("point", group, "weight", "other", "size")
        .agg(F.sum("total").alias("total"))
        .groupBy("point", group, "weight")
        .agg(
            F.max(F.when(own, F.col("size"))).alias("own_size"),
            F.max(F.when(own, ratio(F.col("total"), F.col("size") - 1))).alias("inner"),
            F.min(F.when(~own, ratio(F.col("total"), F.col("size")))).alias("outer"),
        )
    )
    score = F.when(F.col("own_size") == 1, 0.0).otherwise(
        F.coalesce(ratio(F.col("outer") - F.col("inner"), F.greatest("outer", "inner")), F.lit(0.0))
    )
    return scored.agg((F.sum(score * F.col("weight")) / F.sum("weight")).alias("silhouette"))


def adjusted_rand(df: DataFrame, first: str, second: str, weight: Column | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """Adjusted Rand index of two labelings (Hubert & Arabie 1985), per group of ``by``."""
    by = list(by)
    amount = F.count("*") if weight is None else F.sum(weight)
    table = df.groupBy(*by, first, second).agg(amount.alias("n"))
    margins = table.groupingSets(
        [[*by, first, second], [*by, first], [*by, second], by], *by, first, second
    ).agg(F.sum("n").cast("double").alias("n"), F.grouping_id().alias("level"))
    pairs = F.col("n") * (F.col("n") - 1) / 2

    def over(level: int) -> Column:
        return F.sum(F.when(F.col("level") == level, pairs))

    sums = margins.groupBy(*by).agg(
        over(0).alias("both"), over(1).alias("a"), over(2).alias("b"), over(3).alias("all")
    )
    expected = ratio(F.col("a") * F.col("b"), F.col("all"))
    ceiling = (F.col("a") + F.col("b")) / 2
    # Two trivial labelings agree perfectly, though the quotient is undefined.
    index = F.coalesce(ratio(F.col("both") - expected, ceiling - expected), F.lit(1.0))
    return sums.select(*by, index.alias("rand_index"))


# A draw's cut lies within this many standard deviations of where it is expected.
_SLACK = 8.0


def _hash_of(draw: int, keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(draw), *keys)


def _cuts(df: DataFrame, keys: Sequence[str], size: int, rows: int, draws: int, seed: int) -> list[int]:
    """For each draw, the ``size``-th smallest hash of all ``rows`` rows.

    Hashes are spread evenly, so the cut is looked for in a bracket around its expected place.  One
    pass counts the rows below every draw's bracket; only the few inside it, as many as the square
    root of all, become rows of their own and are sorted.
    """
    share = size / rows
    slack = _SLACK * (share * (1 - share) / rows) ** 0.5 + 2 / rows
    while True:
        low, high = (int((max(0.0, min(1.0, share + x)) - 0.5) * (2**64 - 1)) for x in (-slack, slack))
        low, high = max(low, -(2**63)), min(high, 2**63 - 1)
        hashes = [_hash_of(d, keys, seed) for d in range(1, draws + 1)]
        below = df.agg(*[F.count_if(h < F.lit(low)).alias(f"d{d}") for d, h in enumerate(hashes, 1)]).first()
        near = F.filter(
            F.array(*[F.struct(F.lit(d).alias("draw"), h.alias("hash")) for d, h in enumerate(hashes, 1)]),
            lambda x: x["hash"].between(F.lit(low), F.lit(high)),
        )
        inside = df.select(F.inline(near))
        wanted = F.element_at(F.array(*[F.lit(size - below[f"d{d}"]) for d in range(1, draws + 1)]), F.col("draw"))
        place = F.row_number().over(Window.partitionBy("draw").orderBy("hash"))
        found = inside.withColumn("place", place).filter(F.col("place") == wanted).select("draw", "hash").collect()
        if len(found) == draws:  # a row for each draw, which are run parameters
            return [h for _, h in sorted((r["draw"], r["hash"]) for r in found)]
        slack *= 8


def drawn(df: DataFrame, keys: Sequence[str], fraction: float = 0.8, draws: int = 20, seed: int = 0) -> DataFrame:
    """``df`` with the long ``draws``: bit d - 1 is set if the row is in draw d.

    Each draw is an exact sample of floor(fraction × N) rows, those with the smallest hashes.  Rows
    are read once to find the cuts and once for the bits, whatever the number of draws (63 at most),
    and are never copied.  Hashes depend on the keys alone, which are to be unique: a lost executor
    recomputes the same draws.
    """
    if not 1 <= draws <= 63:
        raise ValueError("1 to 63 draws fit a long")
    rows = df.count()
    size = int(fraction * rows)
    if not size:
        return df.withColumn("draws", F.lit(0).cast("long"))
    cuts = _cuts(df, keys, size, rows, draws, seed)
    bits = [
        F.when(_hash_of(d, keys, seed) <= F.lit(cut), F.lit(1 << (d - 1))).otherwise(0).cast("long")
        for d, cut in enumerate(cuts, 1)
    ]
    return df.withColumn("draws", reduce(Column.bitwiseOR, bits))


def _bit(draw: int) -> Column:
    return F.shiftrightunsigned("draws", draw - 1).bitwiseAND(F.lit(1).cast("long"))


def draw_without_replacement(df: DataFrame, keys: Sequence[str], fraction: float = 0.8,
                             draws: int = 20, seed: int = 0) -> DataFrame:
    """The rows of ``drawn`` once for each draw they are in, tagged ``draw`` from 1."""
    chosen = [F.when(_bit(d) == 1, d) for d in range(1, draws + 1)]
    tagged = drawn(df, keys, fraction, draws, seed).withColumn("draw", F.explode(F.array_compact(F.array(*chosen))))
    return tagged.select("draw", *df.columns)


def draw_weights(rows: DataFrame, features: Sequence[str], draws: int) -> DataFrame:
    """``(draw, *features, weight)``: how many rows of each draw share a point.

    ``rows`` has the bits ``draws``.  They are summed to one row per point with a count for each draw,
    and only those few rows are unfolded.
    """
    summed = rows.groupBy(*features).agg(F.array(*[F.sum(_bit(d)) for d in range(1, draws + 1)]).alias("_weights"))
    unfolded = summed.select(*features, F.posexplode("_weights").alias("_place", "weight"))
    return unfolded.filter("weight > 0").select((F.col("_place") + 1).alias("draw"), *features, "weight")


def agreement_by_draw(weights: DataFrame, model: Archetypes, refits: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """Adjusted Rand index, by draw, of the groups of ``model`` with those of each draw's own centres."""
    labelled = assign(weights, model).withColumnRenamed("archetype", "reference")
    z = model.scale.columns()
    # The draw number picks its own refit; draws and groups are run parameters, not data.
    trial = reduce(
        lambda chain, d: chain.when(F.col("draw") == d + 1, _nearest(z, refits[d]).archetype),
        range(1, len(refits)),
        F.when(F.col("draw") == 1, _nearest(z, refits[0]).archetype),
    )
    return adjusted_rand(labelled.withColumn("trial", trial), "reference", "trial", F.col("weight"), ["draw"])


def stability_by_draw(
    df: DataFrame,
    model: Archetypes,
    keys: Sequence[str],
    *,
    draws: int = 20,
    restarts: int = 20,
    fraction: float = 0.8,
    seed: int = 0,
) -> DataFrame:
    """Agreement (adjusted Rand) of the full grouping with a refit on each draw."""
    features = list(model.scale.features)
    rows = drawn(df.select(*keys, *features), keys, fraction, draws, seed)
    weights = materialise(draw_weights(rows, features, draws), "draws")
    fits = fit_many(weights, model.scale, len(model.centres), restarts, seed)
    return agreement_by_draw(weights, model, [fits[draw].centres for draw in range(1, draws + 1)])


def stability(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("rand_index").alias("stability"), F.count("*").alias("draws"))
