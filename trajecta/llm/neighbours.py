"""Nearest neighbours by stable projections and a kd-tree, with a chi-square stopping test.

A vector is projected on a few Gaussian directions.  If ``d`` is the distance of two vectors,
the squared distance of their projections over ``d * d`` follows a chi-square law with as many
degrees of freedom as directions.  Candidates come from a kd-tree over the projections, nearest
first; each is verified on its whole vector, and a query stops once the law says that a vector
closer than its present last neighbour would, with the confidence asked for, have come already.

The largest inner product becomes the least distance when a vector gets one more component that
lifts all to the same length.  Tables are cut into shards of vectors and blocks of queries, so a
task holds one of each, whatever the size of the table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
DIRECTIONS = 6  # even, for the closed form of the chi-square law
CONFIDENCE = 0.98
SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
SEED = 11
_LEAF = 256
_CHUNK = 512


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """Distribution function for an even number of degrees."""
    half = np.asarray(x, np.float64) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    with np.errstate(under="ignore", invalid="ignore", over="ignore"):
        return np.where(half > 500, 1.0, 1 - np.exp(-np.minimum(half, 500)) * total)


class KdTree:
    """Leaves of a kd-tree, with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = _LEAF):
        self.leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            own = stack.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            axis = int(np.ptp(points[own], axis=0).argmax())
            middle = len(own) // 2
            order = np.argpartition(points[own, axis], middle)
            stack += [own[order[middle:]], own[order[:middle]]]
        self.low = np.array([points[x].min(axis=0) for x in self.leaves])
        self.high = np.array([points[x].max(axis=0) for x in self.leaves])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance of each query from each box."""
        out = np.zeros((len(queries), len(self.leaves)))
        for axis in range(queries.shape[1]):
            q = queries[:, axis, None]
            gap = np.maximum(np.maximum(self.low[:, axis] - q, q - self.high[:, axis]), 0)
            out += gap * gap
        return out


def _best(scores: np.ndarray, classes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row, ties to the lower class."""
    order = np.lexsort((classes, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(classes, order, 1)


def search(vectors: np.ndarray, queries: np.ndarray, k: int, length: float, confidence: float = CONFIDENCE) -> np.ndarray:
    """For each query the places of k vectors with the largest inner product, -1 where there are
    fewer.  ``length`` is at least that of every vector.  ``vectors`` are distinct."""
    rng = np.random.default_rng(SEED)
    directions = rng.standard_normal((vectors.shape[1] + 1, DIRECTIONS))
    unit = vectors / length
    lift = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", unit, unit)))
    tree = KdTree(unit @ directions[:-1] + lift[:, None] * directions[-1])
    out = np.full((len(queries), k), -1)
    for start in range(0, len(queries), _CHUNK):
        q = queries[start : start + _CHUNK]
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        far = tree.distances(q @ directions[:-1])
        order = np.argsort(far, axis=1, kind="stable")
        top = np.full((len(q), k), -np.inf)
        who = np.full((len(q), k), len(vectors))
        active = np.arange(len(q))
        for step in range(len(tree.leaves)):
            nearest = order[active, step]
            new = np.full((len(active), _LEAF), -np.inf)
            names = np.full((len(active), _LEAF), len(vectors))
            for leaf in np.unique(nearest):
                rows, own = np.flatnonzero(nearest == leaf), tree.leaves[leaf]
                new[rows, : len(own)] = q[active[rows]] @ unit[own].T
                names[rows, : len(own)] = own
            better = np.flatnonzero(new.max(axis=1) >= top[active, -1])
            at = active[better]
            top[at], who[at] = _best(
                np.concatenate([top[at], new[better]], axis=1), np.concatenate([who[at], names[better]], axis=1), k
            )
            if step + 1 == len(tree.leaves):
                break
            # Both ends have length 1 here, so the squared distance is 2 - 2 <q, x>.
            last = 2 - 2 * top[active, -1]
            ahead = far[active, order[active, step + 1]]
            with np.errstate(divide="ignore", invalid="ignore"):
                sure = chi_square(np.where(last > 0, ahead / last, np.inf), DIRECTIONS) >= confidence
            # An unfilled list goes on; so does one that a box at no distance may still improve.
            active = active[~(sure & np.isfinite(top[active, -1]) & (ahead > 0))]
            if not len(active):
                break
        out[start : start + len(q)] = np.where(who < len(vectors), who, -1)
    return out


def _search_shard(shard: pd.DataFrame, block: pd.DataFrame, k: int, length: float) -> pd.DataFrame:
    empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    if not len(shard) or not len(block):
        return empty
    shard = shard.sort_values("vec_id")
    ids = shard["vec_id"].to_numpy()
    vectors = np.stack(shard["vector"].to_numpy()).astype(np.float64) + 0.0
    # Equal vectors are one candidate, which stands for its smallest ids.
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, member_of = np.unique(raw, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    member_of = place[member_of]
    distinct = vectors[first[order]]
    by_class = np.argsort(member_of, kind="stable")
    bounds = np.searchsorted(member_of[by_class], np.arange(len(distinct) + 1))
    queries = np.stack(block["vector"].to_numpy()).astype(np.float64)
    # One class more, as the query's own may have no other member.
    found = search(distinct, queries, min(k + 1, len(distinct)), length)
    out_q, out_v, out_s = [], [], []
    for own, q, classes in zip(block["vec_id"].to_numpy(), queries, found):
        classes = classes[classes >= 0]
        scores = (distinct[classes] * q).sum(axis=1)
        names = [ids[by_class[bounds[c] : bounds[c + 1]][: k + 1]] for c in classes]
        members = np.concatenate(names)
        values = np.repeat(scores, [len(n) for n in names])
        keep = members != own
        members, values = members[keep], values[keep]
        best = np.lexsort((members, -values))[:k]
        out_q.append(np.full(len(best), own))
        out_v.append(members[best])
        out_s.append(values[best])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _block(of: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(blocks).cast("long"))


def nearest(
    embeddings: DataFrame, query: Column, k: int = K, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: k nearest others of the rows for which ``query`` holds.

    ``embeddings`` has ``vec_id`` and ``embedding``.  Nearness is the inner product in double
    precision, ties go to the smaller vec_id.  Vectors that are null, zero or hold a null or
    non-finite component take no part, nor do rows without a vec_id and vectors whose length is
    not the commonest one (the smaller of equally common lengths counts).  Of rows that repeat a
    vec_id the least vector stands.  With fewer than k candidates all come back; an empty table
    gives no rows.  Other columns are ignored.
    """
    sound = F.expr(
        "embedding IS NOT NULL AND vec_id IS NOT NULL"
        " AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('infinity') AND NOT isnan(x))"
        " AND exists(embedding, x -> x <> 0)"
    )
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(sound)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("vector")).withColumn("is_query", query)
    square = F.aggregate(F.col("vector"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # One row per length of vector.
    sizes = (
        rows.groupBy(F.size("vector").alias("size"))
        .agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("queries"), F.max(square).alias("square"))
        .orderBy(F.col("n").desc(), "size")
        .limit(1)
        .collect()
    )
    size, n, n_queries, square_of = sizes[0] if sizes else (0, 0, 0, 0.0)
    length = math.sqrt(square_of) * (1 + 1e-12) or 1.0
    shards, blocks = _blocks(n, shard_rows), _blocks(n_queries, query_rows)
    rows = rows.filter(F.size("vector") == size).drop("size")
    vectors = rows.select(
        "vec_id", "vector", _block(F.col("vec_id"), shards).alias("shard"), F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("block")
    )
    asked = rows.filter("is_query").select(
        "vec_id", "vector", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), _block(F.col("vec_id"), blocks).alias("block")
    )
    found = (
        vectors.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInPandas(lambda a, b: _search_shard(a, b, k, length), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
