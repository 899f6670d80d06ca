"""Exact, linearly interpolated quantiles over any number of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.session import materialise


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with a double column per entry of ``probabilities``.

    The built-in exact percentile keeps every distinct value of a group in one task.  Here
    equal values are counted first, the distinct ones are range partitioned, and only the
    ranges that hold a wanted rank are numbered.  Nulls are skipped.
    """
    groups = list(by) or ["_all"]
    present = df.filter(F.col(value).isNotNull())
    if not by:
        present = present.withColumn("_all", F.lit(0))
    counts = present.groupBy(*groups, value).agg(F.count("*").alias("_count"))
    stored = materialise(
        counts.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()),
        "quantiles",
    )

    earlier = (
        Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = (
        stored.groupBy(*groups, "_part")
        .agg(F.sum("_count").alias("_size"))
        .select(
            *groups,
            "_part",
            "_size",
            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
            F.sum("_size").over(Window.partitionBy(*groups)).alias("_total"),
        )
    )

    def position(p: float) -> Column:
        return (F.col("_total") - 1) * F.lit(float(p))

    ranks = [f(position(p)) for p in probabilities.values() for f in (F.floor, F.ceil)]
    span_end = F.col("_before") + F.col("_size")
    wanted = reduce(or_, [(F.col("_before") <= r) & (r < span_end) for r in ranks])
    hits = materialise(spans.filter(wanted), "spans")

    inside = Window.partitionBy(*groups, "_part").orderBy(value)
    numbered = (
        stored.join(hits, [*groups, "_part"])
        .withColumn("_to", F.col("_before") + F.sum("_count").over(inside))
        .withColumn("_from", F.col("_to") - F.col("_count"))
    )

    def at(rank: Column) -> Column:
        here = (F.col("_from") <= rank) & (rank < F.col("_to"))
        return F.max(F.when(here, F.col(value).cast("double")))

    columns = []
    for name, p in probabilities.items():
        low, high = at(F.floor(position(p))), at(F.ceil(position(p)))
        share = F.max(position(p) - F.floor(position(p)))
        columns.append((low + share * (high - low)).alias(name))
    return numbered.groupBy(*groups).agg(*columns).select(*by, *probabilities)
