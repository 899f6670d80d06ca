"""Collocations against a brute-force version."""

import random
import re
from collections import Counter

import pytest

from tests.llm.fixtures import awkward
from trajecta.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, top, least, over):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {t[i : i + 2] for t, a in candidates.items() if len(t) == 3 for i in (0, 1) if 100 * a >= over * f[t[i : i + 2]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                cuts = [(1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(seed, rows=160):
    """Words of very uneven frequency, in two languages and none, with repeated passages."""
    rng = random.Random(seed)
    words = ["a", "É", "é", "b-c", "Dd", "dd", "x\xa0y", "　"] + [f"w{k}" for k in range(30)]
    weights = [1 / (k + 1) for k in range(len(words))]
    out = []
    for _ in range(rows):
        w = rng.choices(words, weights, k=rng.randrange(40))
        at = rng.randrange(len(w) + 1)
        w[at:at] = rng.choice([[], ["new", "york"], ["the", "big", "apple"], ["new", "york", "city"]])
        text = "".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "\x0c"]) for x in w)
        out.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text, text, None])))
    return out


@pytest.mark.parametrize("top,least,over,seed", [(3, 10, 50, 1), (1, 4, 50, 2), (40, 6, 80, 3), (2000, 10, 50, 4)])
def test_collocations_match_brute_force(spark, top, least, over, seed):
    rows = texts(seed)
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "lang string, text string, phrase string, n long")
    found = phrases.collocations(docs, top, least, over)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_force(rows, top, least, over)


def test_awkward_documents(spark):
    docs = awkward(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(docs, 50).collect()) == brute_force(rows, 50, 10, 50)
    assert phrases.collocations(awkward(spark, empty=True)).collect() == []


def test_scores_beyond_64_bits(spark):
    a, l, r = 9_999_999_999_999, 10_000_000_000_000, 9_999_999_999_999
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score("l", "r").alias("s"))
    assert row.head().s == 1_000_000 * a * a // (l * r) == 999_999


def test_chunks_of_texts_add_up(spark, monkeypatch):
    rows = texts(5, 60)
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    monkeypatch.setattr(phrases, "_CHUNK_BYTES", 200)
    assert sorted(tuple(r) for r in phrases.collocations(docs, 20, 4).collect()) == brute_force(rows, 20, 4, 50)
