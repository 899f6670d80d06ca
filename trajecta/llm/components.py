"""Connected components of a graph of long node ids, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.session import materialise

MAX_ROUNDS = 60


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return (
        both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def _is_forest_of_stars(e: DataFrame) -> bool:
    """No node has two parents, and no parent has one."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        e.select("v", F.lit(0), F.lit(1))
    )
    odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return odd.filter("up > 1 OR (up > 0 AND down > 0)").limit(1).count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; component is its smallest node.

    Alternating large-star and small-star rounds: every round is two aggregations and two
    joins, its edges are written to the shared folder, and a node's neighbours are never
    gathered into one row.  Loops (a = b), repeated edges and edges with a null end give no
    row of their own; no edges give an empty result.
    """
    e = (
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialise(e, "edges")
    for _ in range(MAX_ROUNDS):
        if _is_forest_of_stars(e):
            break
        e = materialise(_small_star(_large_star(e)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct()
    )
