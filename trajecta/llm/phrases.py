"""Phrase collocations by best-first branch and bound over prefix counts.

A phrase grows from its prefix.  With a occurrences of a phrase, l of its first part and r of the
rest, its score is at most a a / (l r) at any cut.  Words that occur too seldom are no prefix of a
candidate, so pairs are counted among the others only.  A pair with a occurrences whose first word
has l bounds its own score and that of every phrase it grows into by a / l, as r is at least a.  So
pairs are expanded from the highest bound down, in whole passes over the texts, and the search
ends in a language when no pair is left whose bound reaches the last score that counts, ties
included.

What a pass looks for goes to the tasks as bits of a fixed number, at the places that hashes of
the wanted phrases name.  They let through all that is wanted and some that is not; every count
is taken on the words themselves, and a phrase passes with all its occurrences or with none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajecta.llm.words import mixed
from trajecta.session import materialise

LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases of a language
OVER = 50  # a longer candidate with so many hundredths of a phrase's occurrences takes its place
UNKNOWN = "und"
SCALE = 1_000_000
_FIRST = 4  # pairs expanded at first, for each phrase of the result
_GROWTH = 4
_BITS = 1 << 24
_CHUNK_BYTES = 2 << 20
_MOST_BYTES = 8 << 20

# Lower-cases A-Z; what ends a piece becomes a line feed, and a tab a blank.
_PLAIN = bytes(
    10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)


@dataclass(frozen=True)
class Tokens:
    """Words of some texts: numbers into ``names``, and whether the next word is in the same piece."""

    codes: np.ndarray
    names: pa.Array
    joined: np.ndarray


def tokens(texts: list[bytes]) -> Tokens:
    raw = np.frombuffer(b"\n".join(texts).translate(_PLAIN), np.uint8)
    apart = (raw == 32) | (raw == 10)
    edges = np.flatnonzero(np.diff(np.r_[True, apart, True].astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    letters = pa.py_buffer(raw[~apart].tobytes())
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters])
    coded = words.dictionary_encode()
    piece = np.cumsum(raw == 10)[starts]
    joined = np.r_[piece[1:] == piece[:-1], False][: len(starts)]
    return Tokens(coded.indices.to_numpy().astype(np.int64), coded.dictionary, joined)


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(first * np.uint64(0x9E3779B97F4A7C15) + second, 13)


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes % np.uint64(_BITS)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def _counted(t: Tokens, at: np.ndarray, width: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct phrases of ``width`` words from the places ``at``, and how often they occur."""
    key, size, parts = t.codes[at], len(t.names), []
    for k in range(1, width):
        # Numbered anew before each word, so that no product passes 64 bits.
        known, key = np.unique(key, return_inverse=True)
        parts.append(known)
        key = key * size + t.codes[at + k]
    known, counts = np.unique(key, return_counts=True)
    columns = []
    for table in reversed(parts):
        columns.append(known % size)
        known = table[known // size]
    columns.append(known)
    words = [t.names.take(pa.array(c)) for c in reversed(columns)]
    if width > 1:
        words = [pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.large_binary()))]
    return words[0].cast(pa.binary()).cast(pa.string()), counts


def _words(lang: str, t: Tokens) -> tuple[pa.Array, np.ndarray]:
    """Counts of words, and of all of them under null."""
    names, counts = _counted(t, np.arange(len(t.codes)), 1)
    return pa.concat_arrays([names, pa.nulls(1, pa.string())]), np.r_[counts, len(t.codes)]


def _pairs(lang: str, t: Tokens, wanted: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    often = _holds(wanted, _word_hashes(lang, t.names.to_pylist()))[t.codes]
    return _counted(t, np.flatnonzero(t.joined[:-1] & often[:-1] & often[1:]), 2)


def _triples(lang: str, t: Tokens, prefixes: np.ndarray, often: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Counts of triples of frequent words that begin or end with one of the pairs."""
    h = _word_hashes(lang, t.names.to_pylist())
    frequent = _holds(often, h)[t.codes]
    h = h[t.codes]
    pair = t.joined[:-1] & frequent[:-1] & frequent[1:]
    wanted = np.zeros(len(pair), bool)
    wanted[pair] = _holds(prefixes, _pair_hashes(h[:-1][pair], h[1:][pair]))
    return _counted(t, np.flatnonzero((wanted[:-1] | wanted[1:]) & pair[:-1] & pair[1:]), 3)


def _phrase_counts(docs: DataFrame, count: Callable, *filters: np.ndarray) -> DataFrame:
    """``(lang, phrase, n)`` over all documents, of what ``count`` finds in a chunk of texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)  # a fixed number of bits

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(lang: str) -> pa.RecordBatch:
            names, counts = count(lang, tokens(held.pop(lang)), *shared.value)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names), pa.string()), names, pa.array(counts, pa.int64())], names=["lang", "phrase", "n"]
            )

        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, []).append(text.as_buffer().to_pybytes())
                size[lang] = size.get(lang, 0) + len(held[lang][-1])
                if size[lang] >= _CHUNK_BYTES:
                    del size[lang]
                    yield flush(lang)
            if sum(size.values()) >= _MOST_BYTES:  # many languages
                size = {}
                for each in list(held):
                    yield flush(each)
        for each in list(held):
            yield flush(each)

    texts = docs.filter("text IS NOT NULL").select(
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text")
    )
    found = texts.mapInArrow(rows, "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _bits(phrases: DataFrame) -> np.ndarray:
    """Bits of all ``(lang, phrase)`` of one or two words, ``_BITS`` of them whatever the table holds."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            out = [np.empty(0, np.int64)]
            for lang, phrases in table.groupby("lang")["phrase"]:
                words = [p.encode().split(b" ") for p in phrases]
                h = _word_hashes(lang, [w[0] for w in words])
                if len(words[0]) > 1:
                    h = _pair_hashes(h, _word_hashes(lang, [w[1] for w in words]))
                out.append((h % np.uint64(_BITS)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["at"])

    at = phrases.select("lang", "phrase").mapInArrow(places, "at long")
    words = (
        at.groupBy(F.shiftright("at", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
        .toArrow()  # at most _BITS / 64 rows
    )
    out = np.zeros(_BITS >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _part(first: int, size: int):
    return F.array_join(F.slice(F.split("phrase", " "), first, size), " ")


def _with_count(df: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    known = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    return df.join(known, ["lang", part])


def _score(l: str, r: str):
    """floor(SCALE a a / (l r)), exactly: counts to 10^13 are taken."""
    wide = "decimal(38,0)"
    return F.expr(
        f"CAST(CAST({SCALE} AS {wide}) * CAST(a AS {wide}) * CAST(a AS {wide})"
        f" div (CAST({l} AS {wide}) * CAST({r} AS {wide})) AS bigint)"
    )


def _cut_value(scores: DataFrame, column: str, wanted) -> DataFrame:
    """``(lang, cut)``: the largest value that ``wanted`` rows of a language reach, if so many there
    are.  Values lie between 0 and ``SCALE``, so a language has so many rows at most to sort."""
    counted = scores.groupBy("lang", F.col(column).alias("cut")).agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("cut")))
    return counted.withColumn("upto", upto).filter(F.col("upto") >= wanted).groupBy("lang").agg(F.max("cut").alias("cut"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, over: int = OVER) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words
    ``[^\\x20\\x09]+``.  Candidates are phrases of 2 or 3 words with ``least`` occurrences or more;
    ``a``, ``l`` and ``r`` count the phrase and the two parts of its cut of least score (the first
    such cut), ``n`` all words of the language, and the score is floor(1000000 a a / (l r)).  A pair
    inside a longer candidate that has ``over`` hundredths of its occurrences or more is left out.
    Ranks go by score, occurrences, and phrase in UTF-8 order, so there are no ties.

    A null lang is ``und``; a null or empty text has no words; repeated rows count again; other
    columns are ignored; an empty table, or one without candidates, gives no rows.  Whole texts of
    any length are counted.
    """
    words = materialise(_phrase_counts(docs, _words).filter(F.col("phrase").isNull() | (F.col("n") >= least)), "words")
    totals = words.filter("phrase IS NULL").select("lang", F.col("n").alias("total"))
    words = words.filter("phrase IS NOT NULL")
    often = _bits(words)
    pairs = _phrase_counts(docs, _pairs, often).filter(F.col("n") >= least)
    pairs = pairs.withColumn("first", _part(1, 1)).withColumn("second", _part(2, 1))
    pairs = _with_count(_with_count(pairs, words, "first", "l"), words, "second", "r").withColumn("a", F.col("n"))
    pairs = materialise(
        pairs.select(
            "lang", "phrase", "n", "a", "l", "r", _score("l", "r").alias("score"),
            F.expr(f"CAST(CAST({SCALE} AS decimal(38,0)) * CAST(a AS decimal(38,0)) div CAST(l AS decimal(38,0)) AS bigint)").alias("bound"),
        ),
        "pairs",
    )
    triples, opened, frontier = None, None, _frontier(pairs, top * _FIRST)
    wanted = top * _FIRST
    while True:
        fresh = pairs.join(frontier, "lang").filter("bound >= cut")
        if opened is not None:
            fresh = fresh.drop("cut").join(opened, "lang", "left").filter("cut IS NULL OR bound < cut")
        found = _phrase_counts(docs, _triples, _bits(fresh), often).filter(F.col("n") >= least)
        scored = _scored_triples(found, words, pairs)
        triples = scored if triples is None else triples.union(scored)
        triples = materialise(triples.dropDuplicates(["lang", "phrase"]), "triples")
        opened = materialise(frontier, "opened")
        known = materialise(_known(pairs, triples, opened, over), "phrases")
        last = _cut_value(known, "score", F.lit(top))
        wanted *= _GROWTH
        # A language that has all its phrases is opened down to the last score; others further.
        further = opened.join(last.withColumnRenamed("cut", "last"), "lang", "left")
        further = further.join(_frontier(pairs, wanted).withColumnRenamed("cut", "next"), "lang")
        further = further.select("lang", F.least("cut", F.coalesce("last", "next")).alias("cut"))
        frontier = materialise(further, "frontier")
        unsettled = pairs.join(opened, "lang").join(frontier.withColumnRenamed("cut", "next"), "lang")
        if unsettled.filter("bound < cut AND bound >= next").isEmpty():
            break
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )


def _frontier(pairs: DataFrame, wanted: int) -> DataFrame:
    """``(lang, cut)``: the bound down to which a language's best ``wanted`` pairs reach; 0, which
    opens all, if it has fewer."""
    cut = _cut_value(pairs, "bound", F.lit(wanted))
    return pairs.select("lang").distinct().join(cut, "lang", "left").select("lang", F.coalesce("cut", F.lit(0)).alias("cut"))


def _scored_triples(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    t = found.select(
        "lang", "phrase", F.col("n").alias("a"), _part(1, 1).alias("one"), _part(3, 1).alias("three"),
        _part(1, 2).alias("head"), _part(2, 2).alias("tail"),
    )
    t = _with_count(_with_count(t, words, "one", "l1"), pairs, "tail", "r1")
    t = _with_count(_with_count(t, words, "three", "r2"), pairs, "head", "l2")
    t = t.withColumn("s1", _score("l1", "r1")).withColumn("s2", _score("l2", "r2"))
    early = F.col("s1") <= F.col("s2")
    return t.select(
        "lang", "phrase", "a",
        F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"), "head", "tail",
    )


def _known(pairs: DataFrame, triples: DataFrame, opened: DataFrame, over: int) -> DataFrame:
    """Phrases whose fate is known: all triples found, and the opened pairs that none of them replaces."""
    inside = triples.select("lang", "a", F.explode(F.array("head", "tail")).alias("phrase"))
    longest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = (
        pairs.join(opened, "lang")
        .filter("bound >= cut")
        .join(longest, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * over))
    )
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    return kept.select(*columns).union(triples.select(*columns))


_UPPER = "".join(map(chr, range(65, 91)))
ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists
), counted AS (
  SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM grams GROUP BY lang, k, phrase
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f, unnest(range(1, c.k)) AS cut, c.w FROM counted c WHERE c.k > 1 AND c.f >= 10
), scored AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, x.f AS l, y.f AS r, c.cut,
         CAST(1000000::HUGEINT * c.f * c.f // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.cut], ' ') AND x.k = c.cut
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ') AND y.k = c.k - c.cut
), candidates AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, f
  FROM counted WHERE k = 3 AND f >= 10
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase
), ranked AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY c.score DESC, c.a DESC, c.phrase) AS rank
  FROM candidates c LEFT JOIN longer g ON g.lang = c.lang AND g.phrase = c.phrase AND c.k = 2
  WHERE g.f IS NULL OR 100 * g.f < 50 * c.a
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang) t ON t.lang = r.lang
WHERE r.rank <= 2000
"""
