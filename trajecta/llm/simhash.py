"""SimHash near-duplicates, found through a hierarchical index in Gray order.

Distinct fingerprints meet in upper nodes: a node is a masked bit pattern that its members
share, and the masks are chosen so that any two fingerprints within the distance share a
node.  A node with more members than ``node_rows`` is split into child nodes, whose longer
masks keep that promise, so every node that is searched is bounded and no member is left
out.  Inside a node the members lie in Gray order, blocks of neighbours factor out the bits
they agree on, and a block is dropped whole once the differences that a query has gathered
on the way down exceed the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.columns import unused
from trajecta.llm.components import connected_components
from trajecta.llm.words import hashes, words
from trajecta.session import materialise

BITS = 64
SHINGLE_WORDS = 3
MAX_DISTANCE = 2
NODE_ROWS = 2048  # members of a node that one task searches
_FANOUT = 16
_SMALL = 32  # nodes up to this size are one block


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash as a signed long; zero for a null text and one without words.

    Shingles are counted with their repeats; a text with fewer words than ``width`` is one
    shingle.  A bit is set if more than half of the shingle hashes have it.
    """
    w = words(text)
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) <= width else list(map(b" ".join, zip(*(w[i:] for i in range(width)))))
    h = hashes(grams).astype("<u8")
    counts = np.zeros(BITS, np.int64)
    for start in range(0, len(h), 65_280):  # 256 blocks of 255 rows, whose sums fit a byte
        bits = np.unpackbits(h[start : start + 65_280].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = SHINGLE_WORDS, name: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a long."""

    @F.pandas_udf("long")
    def of(column: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, width) for x in column], dtype="int64")

    return docs.withColumn(name, of(F.col(text).cast("binary")))


def gray_rank(code: Column) -> Column:
    """Place of a 64-bit code in Gray order (as an unsigned value in a long)."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


class GrayIndex:
    """Search among the members of one node, given in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        # Levels from the leaves up: (bits on which a block agrees, their values).
        ones, zeros = codes, ~codes
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ones) > 1:
            starts = np.arange(0, len(ones), _FANOUT)
            ones = np.bitwise_and.reduceat(ones, starts)
            zeros = np.bitwise_and.reduceat(zeros, starts)
            self.levels.append((ones | zeros, ones))

    def pairs(self, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """All ``(i, j)``, i < j, whose codes differ in at most ``distance`` bits."""
        found_i, found_j = [], []
        for start in range(0, len(self.codes), 256):  # a block of queries at a time
            i = np.arange(start, min(start + 256, len(self.codes)))
            i, j = self._descend(i, distance)
            found_i.append(i)
            found_j.append(j)
        return np.concatenate(found_i), np.concatenate(found_j)

    def _descend(self, query: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        node = np.zeros(len(query), np.int64)
        gathered = np.zeros(len(query), np.int64)
        seen = np.zeros(len(query), np.uint64)  # bits already compared above
        for depth in range(len(self.levels) - 1, -1, -1):
            agreed, values = self.levels[depth]
            if depth < len(self.levels) - 1:
                query, node, gathered, seen = self._children(query, node, gathered, seen, len(agreed))
            fresh = agreed[node] & ~seen
            gathered = gathered + np.bitwise_count((self.codes[query] ^ values[node]) & fresh)
            keep = gathered <= distance
            query, node, gathered, seen = query[keep], node[keep], gathered[keep], (seen | fresh)[keep]
        query, node, gathered, seen = self._children(query, node, gathered, seen, len(self.codes))
        rest = (self.codes[query] ^ self.codes[node]) & ~seen
        keep = (query < node) & (gathered + np.bitwise_count(rest) <= distance)
        return query[keep], node[keep]

    @staticmethod
    def _children(query, node, gathered, seen, size):
        child = (node[:, None] * _FANOUT + np.arange(_FANOUT)).ravel()
        inside = child < size
        return (
            np.repeat(query, _FANOUT)[inside],
            child[inside],
            np.repeat(gathered, _FANOUT)[inside],
            np.repeat(seen, _FANOUT)[inside],
        )


def _node_pairs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, distance: int):
    """Linked positions inside each node of one table of whole nodes."""
    left, right = [], []
    small = sizes <= _SMALL
    end = np.repeat(np.where(small, starts + sizes, 0), sizes)
    for lag in range(1, int(sizes[small].max(initial=1))):
        i = np.arange(len(codes) - lag)
        i = i[i + lag < end[: len(i)]]
        i = i[np.bitwise_count(codes[i] ^ codes[i + lag]) <= distance]
        left.append(i)
        right.append(i + lag)
    for start, size in zip(starts[~small], sizes[~small]):
        i, j = GrayIndex(codes[start : start + size]).pairs(distance)
        left.append(i + start)
        right.append(j + start)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each position through the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _search_nodes(batches: Iterator[pd.DataFrame], distance: int, node_rows: int) -> Iterator[pd.DataFrame]:
    """Star links of every node; members of larger nodes come back unlinked, with their mask.

    Rows come sorted by node; a node may go on over several batches.
    """
    held = pd.DataFrame({"mask": [], "key": [], "fp": []}, dtype="int64")
    passing = None  # the large node whose members are being handed on

    def linked(table: pd.DataFrame) -> pd.DataFrame:
        mask, key = table["mask"].to_numpy(), table["key"].to_numpy()
        new = np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.r_[starts, len(mask)])
        large = np.repeat(sizes > node_rows, sizes)
        codes = table["fp"].to_numpy().view(np.uint64)
        fits = sizes <= node_rows
        kept = codes[~large]
        at = np.cumsum(np.r_[0, sizes[fits]])[:-1]
        i, j = _node_pairs(kept, at, sizes[fits], distance)
        root = _roots(len(kept), i, j)
        own = np.flatnonzero(root != np.arange(len(kept)))
        links = pd.DataFrame({"a": kept[root[own]].view(np.int64), "b": kept[own].view(np.int64)})
        later = table.loc[large, ["fp", "mask"]].rename(columns={"fp": "a"})
        return pd.concat([links.assign(mask=0, later=False), later.assign(b=0, later=True)])[["a", "b", "mask", "later"]]

    for batch in batches:
        if passing is not None:
            same = ((batch["mask"] == passing[0]) & (batch["key"] == passing[1])).to_numpy()
            if same.any():
                yield batch.loc[same, ["fp", "mask"]].rename(columns={"fp": "a"}).assign(b=0, later=True)[["a", "b", "mask", "later"]]
                batch = batch[~same]
            if len(batch):
                passing = None
        held = pd.concat([held, batch], ignore_index=True)
        if not len(held):
            continue
        last = (int(held["mask"].iloc[-1]), int(held["key"].iloc[-1]))
        tail = ((held["mask"] == last[0]) & (held["key"] == last[1])).to_numpy()
        if tail.sum() > node_rows:
            passing, tail = last, np.zeros(len(held), bool)
        if (~tail).any():
            yield linked(held[~tail])
        held = held[tail]
    if len(held):
        yield linked(held)


def _masks() -> list[int]:
    """Two of four words of 16 bits: two codes within distance 2 agree on one such pair."""
    return [(0xFFFF << 16 * i) | (0xFFFF << 16 * j) for i, j in combinations(range(4), 2)]


def _child_masks(mask: int, distance: int) -> list[int]:
    """``mask`` lengthened by each of ``distance + 1`` parts of the bits it leaves open."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    size, extra = divmod(len(free), distance + 1)
    cuts = [size * k + min(k, extra) for k in range(distance + 2)]
    return [mask | sum(1 << b for b in free[cuts[k] : cuts[k + 1]]) for k in range(distance + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(codes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links ``(a, b)`` that join all distinct ``codes(fp)`` within two bits of each other.

    Only a spanning set of each node's links is given, so the rows never exceed six times
    the codes (and three times more for each level that a crowded node is split).
    """
    masks = _masks()
    rows = codes.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    parts: list[DataFrame] = []
    while True:
        nodes = (
            rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
            .repartition("mask", "key")
            .sortWithinPartitions("mask", "key", gray_rank(F.col("fp")))
            .select("mask", "key", "fp")
        )
        searched = materialise(
            nodes.mapInPandas(
                lambda batches: _search_nodes(batches, MAX_DISTANCE, node_rows),
                "a long, b long, mask long, later boolean",
            ),
            "links",
        )
        parts.append(searched.filter("NOT later").select("a", "b"))
        crowded = searched.filter("later")
        present = [r["mask"] for r in crowded.select("mask").distinct().collect()]  # a few masks
        if not present:
            break
        children = {m: [_signed(c) for c in _child_masks(m & (2**BITS - 1), MAX_DISTANCE)] for m in present}
        if all(c == [m] * len(c) for m, c in children.items()):
            raise ValueError("codes must be distinct")
        lookup = F.create_map(*[x for m, c in children.items() for x in (F.lit(m), F.array(*[F.lit(y) for y in c]))])
        rows = crowded.select(F.col("a").alias("fp"), F.explode(lookup[F.col("mask")]).alias("mask")).distinct()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _placed(classes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """``classes(fp, ...)`` with the component of each fingerprint."""
    nodes = connected_components(links(classes.select("fp").distinct(), node_rows))
    return classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE_WORDS, node_rows: int = NODE_ROWS
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits.  ``component_id`` is the smallest doc_id that
    can be reached through documents whose fingerprints differ in at most two bits.  Null and
    wordless texts have fingerprint zero and link like any other; rows without a doc_id take
    part, and have a null component if nothing they reach has an id.  Repeated rows come back
    repeated.  Only ids and fingerprints are shuffled, never texts; other columns are ignored.
    """
    prints = materialise(
        fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", width)
        .select("doc_id", F.col("_fp").alias("fp")),
        "prints",
    )
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    placed = materialise(_placed(classes, node_rows), "placed")
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = placed.join(lows, "component").select("fp", "component_id")
    return prints.join(ids, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest doc_id.

    Of a group's rows that share this doc_id the first by text stays; another text under it that
    is in another group counts there.  Of the rows without a doc_id one more of each group stays,
    as nothing can name them.  Columns are those of ``docs``.
    """
    keep, spot = unused(docs, "keep"), unused(docs, "spot")
    rows = fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select(
        "_fp", F.isnull("doc_id").alias("nameless"), F.struct("doc_id", F.xxhash64("text").alias("spot")).alias("first")
    )
    # Least rows of each fingerprint, then of each component; never all rows of a group in one task.
    classes = materialise(
        rows.withColumnRenamed("_fp", "fp").groupBy("fp", "nameless").agg(F.min("first").alias("first")), "classes"
    )
    first = _placed(classes).groupBy("component", "nameless").agg(F.min("first").alias("first"))
    chosen = materialise(first.select(F.col("first.doc_id").alias(keep), F.col("first.spot").alias(spot)), "chosen")
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(keep)) & (F.xxhash64("text") == F.col(spot))
    return docs.join(chosen, match).dropDuplicates([keep, spot]).select(*[F.col(f"`{c}`") for c in docs.columns])
