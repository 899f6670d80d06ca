"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents lie end to end in a seeded order, cut into blocks of equal numbers
of words.  The blocks of the whole mix are apportioned to the sources by highest quotients
``target / (2k - 1)``; shard after shard takes the next seats, so each shard has an integer
quota of every source.  A source then gives whole passes over its blocks, and the first
blocks of the seeded order for what is left.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.columns import unused
from trajecta.llm.words import WORD
from trajecta.session import materialise

BLOCK_WORDS = 32
SHARDS = 8
SEED = 7
WEIGHTS = (5, 2, 1)
MOST_PASSES = 3

_BUCKET_DIGITS = 3  # hex digits: 4096 stretches of the seeded order of each source


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """Hex digits that put documents in a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes.  No target exceeds ``most`` times its source's size: the sources are capped in the
    order of cap / weight until what remains, shared by weight, fits under the next cap.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rank = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    onward = rank.rowsBetween(0, Window.unboundedFollowing)
    nth = ((F.row_number().over(named) - 1) % len(weights)).cast("int")
    df = (
        sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), nth + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("capped", _exact(F.col("cap")) * F.sum("weight").over(onward) < _exact(F.col("left")) * F.col("weight"))
    )
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0))
    share = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return df.withColumn(
        "target",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
            (F.col("weight") * left).cast("double") / share.cast("double")
        ),
    ).select("source", "source_size", "weight", "target")


def quotas(planned: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``(source, shard, quota, upto)``: blocks of each source in each shard, and up to its end.

    The seats of the first s shards are a Sainte-Laguë apportionment of their own.  Seats
    surely won and surely lost follow from the divisor, so only a few quotients of each source
    are ranked, whatever the number of blocks.  Equal quotients go to the earlier source.
    """
    everything = Window.partitionBy()
    df = (
        planned.select("source", "source_size", "target")
        .withColumn("total", F.sum("target").over(everything))
        .withColumn("n", F.sum(F.when(F.col("target") > 0, 1).otherwise(0)).over(everything))
        .withColumn("all_seats", F.floor(F.sum("source_size").over(everything) / block_words))
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("seats", F.expr(f"all_seats * shard div {shards}"))
    )

    def won(seats: Column) -> Column:
        return F.when(
            (seats > 0) & (F.col("total") > 0), F.floor(F.col("target") * seats / F.col("total") + 0.5)
        ).otherwise(F.lit(0))

    half = F.col("n") / 2
    df = df.withColumn("sure", F.greatest(won(F.col("seats") - half) - 1, F.lit(0))).withColumn(
        "possible", F.when(F.col("target") > 0, won(F.col("seats") + half) + 1).otherwise(F.lit(0))
    )
    seat = (
        df.withColumn("open", F.col("seats") - F.sum("sure").over(Window.partitionBy("shard")))
        .filter("possible > sure")
        .withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("possible"))))
        .withColumn("quotient", F.col("target") / (2 * F.col("k") - 1))
    )
    order = Window.partitionBy("shard").orderBy(F.col("quotient").desc(), F.col("source").asc_nulls_last(), "k")
    gained = (
        seat.withColumn("place", F.row_number().over(order))
        .filter("place <= open")
        .groupBy("source", "shard")
        .agg(F.count("*").alias("gained"))
    )
    a, b = df.alias("a"), gained.alias("b")
    joined = a.join(b, F.expr("a.source <=> b.source AND a.shard = b.shard"), "left").select(
        "a.source", "a.shard", (F.col("sure") + F.coalesce("gained", F.lit(0))).alias("upto")
    )
    earlier = F.lag("upto", 1, 0).over(Window.partitionBy("source").orderBy("shard"))
    return joined.select("source", "shard", (F.col("upto") - earlier).alias("quota"), "upto")


def plan(sized: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Per source: ``source_size, target, quota`` (blocks), ``passes`` over all its blocks and
    ``extra`` words of one more."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = materialise(targets(by_source), "targets")
    q = quotas(planned, block_words, shards).filter(F.col("shard") == shards).select(F.col("source").alias("q_source"), "upto")
    return (
        planned.join(q, F.expr("source <=> q_source"))
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words))
        .withColumn("quota", F.least("upto", F.col("blocks") * MOST_PASSES))
        .withColumn("passes", F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(F.lit(0)))
        .withColumn("extra", (F.col("quota") - F.col("passes") * F.col("blocks")) * block_words)
        .select("source", "source_size", "target", "quota", "passes", "extra")
    )


def shard_blocks(sized: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """``(shard, source, pass, block)``: every block of the mix, in the shard that takes it."""
    per_source = plan(sized, block_words, shards)
    q = quotas(per_source, block_words, shards).select(F.col("source").alias("q_source"), "shard", "quota", "upto")
    blocks = F.ceil(F.col("source_size") / block_words)
    return (
        per_source.drop("quota")
        .withColumn("blocks", blocks)
        .join(q, F.expr("source <=> q_source"))
        .filter("quota > 0 AND blocks > 0")
        .withColumn("seat", F.explode(F.expr("sequence(upto - quota, upto - 1)")))
        .filter(F.col("seat") < F.col("blocks") * MOST_PASSES)
        .select("shard", "source", F.expr("seat div blocks").alias("pass"), F.expr("seat % blocks").alias("block"))
    )


def draw(sized: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``sized(doc_id, source, size, ...)`` with ``source_size``, ``target`` and ``taken``.

    ``taken`` counts a document's words in the mix, repeats included: all its words in each
    pass, and those before the source's ``extra`` mark in the seeded order.  A running sum
    places the documents; it is taken inside 4096 stretches of the order, whose own sums are
    added up first, so a hot source is spread over many tasks.  Further columns are kept; among
    rows alike in doc_id and size the order follows ``tie``.
    """
    stretch = F.substring("order", 1, _BUCKET_DIGITS)
    df = sized.withColumn("order", seeded(F.col("doc_id"), seed)).withColumn("stretch", stretch)
    sums = df.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("words").over(along), F.lit(0)))
    p = plan(sized, block_words, shards).select(F.col("source").alias("p_source"), "source_size", "target", "passes", "extra")
    starts = materialise(
        starts.join(p, F.expr("source <=> p_source")).select(
            F.col("source").alias("s_source"), F.col("stretch").alias("s_stretch"), "start", "source_size", "target", "passes", "extra"
        ),
        "stretches",
    )
    inside = (
        Window.partitionBy("source", "stretch")
        .orderBy("order", "doc_id", "size", "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at = F.col("start") + F.coalesce(F.col("inside"), F.lit(0))
    return (
        df.withColumn("inside", F.sum("size").over(inside))
        .join(starts, F.expr("source <=> s_source AND stretch = s_stretch"))
        .withColumn("last", F.least(F.greatest(F.col("extra") - at, F.lit(0)), F.col("size")))
        .withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))
        .drop("order", "stretch", "inside", "s_source", "s_stretch", "start", "extra")
    )


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, one row per row of ``docs``.

    Null texts and texts without words have size 0 and taken 0.  A null source is a source of
    its own.  Rows without a doc_id take part, in the order of their text's hash.  Rows alike
    in every way share the same place or neighbouring ones, so the result is the same whichever
    comes first.  Texts are read once and not shuffled.  Other columns are ignored.
    """
    sized = materialise(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sized"
    )
    return draw(sized, block_words, shards, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document comes once for each pass over its source and once more if the seeded blocks
    hold it; the one document at the end of a source's blocks is cut after their last word.
    Documents without words are in no block and go.  Word counts are written before they are
    used, so no order is drawn twice.
    """
    row = unused(docs, "row")
    packed = docs.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), F.struct(*docs.columns).alias(row)
    )
    drawn = draw(packed, block_words, SHARDS, seed).filter("taken > 0")
    words = F.regexp_extract_all(f"{row}.text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    copies = (
        drawn.withColumn("n", F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        .withColumn(
            "piece",
            F.when(
                (F.col("copy") > F.col("passes")) & (F.col("last") < F.col("size")),
                F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("last"), F.lit(1)).cast("int")), ""),
            ).otherwise(F.col(f"{row}.text")),
        )
    )
    return copies.select(*[F.col("piece").alias(c) if c == "text" else F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS spot
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS HUGEINT) AS s,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS HUGEINT) AS w
  FROM sized GROUP BY source
), cut AS (
  -- the common rate: the lowest that any number of capped sources leaves to the others
  SELECT p.source, p.s, p.w,
         3 * p.s * (SELECT sum(r.w) FROM per_source r
                    WHERE (3 * r.s / r.w, r.source IS NULL, r.source) >= (3 * p.s / p.w, p.source IS NULL, p.source))
         < p.w * ((SELECT sum(s) FROM per_source)
                  - coalesce((SELECT sum(3 * r.s) FROM per_source r
                              WHERE (3 * r.s / r.w, r.source IS NULL, r.source) < (3 * p.s / p.w, p.source IS NULL, p.source)), 0)) AS capped
  FROM per_source p
), goals AS (
  SELECT source, s,
         CASE WHEN capped THEN CAST(3 * s AS DOUBLE)
              ELSE CAST(w * ((SELECT sum(s) FROM cut) - coalesce((SELECT sum(3 * s) FROM cut WHERE capped), 0)) AS DOUBLE)
                   / CAST((SELECT sum(w) FROM cut WHERE NOT capped) AS DOUBLE) END AS target
  FROM cut
), quotient AS (
  SELECT g.source, g.target / (2 * k.k - 1) AS q, k.k
  FROM goals g, range(1, CAST(2 + (SELECT sum(s) FROM goals) // {BLOCK_WORDS} AS BIGINT)) AS k(k)
  WHERE g.target > 0
), winners AS (
  SELECT source FROM quotient
  ORDER BY q DESC, source NULLS LAST, k LIMIT (SELECT CAST(sum(s) // {BLOCK_WORDS} AS BIGINT) FROM goals)
), won AS (
  SELECT g.source, g.s, g.target,
         least((SELECT count(*) FROM winners x WHERE x.source IS NOT DISTINCT FROM g.source),
               3 * ((g.s + {BLOCK_WORDS - 1}) // {BLOCK_WORDS})) AS blocks_won
  FROM goals g
), spans AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY spot, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a
  FROM sized
)
SELECT d.doc_id, d.size, CAST(o.s AS BIGINT) AS source_size, o.target,
       CAST(CASE WHEN o.s = 0 THEN 0
            ELSE d.size * (o.blocks_won // nb) + greatest(0, least(d.size, {BLOCK_WORDS} * (o.blocks_won % nb) - d.a)) END AS BIGINT) AS taken
FROM spans d JOIN (SELECT *, greatest(1, (s + {BLOCK_WORDS - 1}) // {BLOCK_WORDS}) AS nb FROM won) o
  ON d.source IS NOT DISTINCT FROM o.source
"""
