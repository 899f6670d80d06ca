"""Awkward documents that every operator must take."""

from __future__ import annotations

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, keep string, score string, size string, doc string, ver string, spans string, cut string, copy string"
)

LONG = " ".join(f"wörd{i % 997}x{i % 13}" for i in range(60_000))


def awkward(spark, empty: bool = False):
    """Nulls in any column, empty, blank and very long texts, repeated rows, clashing columns."""
    extra = ("r", None, "s", "z", "d", "v", "p", "c", "y")
    rows = [
        (1, "plain words in a short text", "en", "a", 27),
        (2, "plain words in a short text", None, "b", 27),
        (3, None, "en", "a", None),
        (4, "", "en", None, 0),
        (5, " \t\n\x0b\f\r ", "de", "b", 7),
        (None, "a text without any id but with words", "en", "a", None),
        (None, None, None, None, None),
        (6, LONG, "de", "a", len(LONG)),
        (7, LONG + " and a tail", "de", "c", None),
        (8, "1234 !!! 99", "fr", "c", 11),
        (9, "Ünïcödé 😀 İstanbul ΣΑΣ <|endoftext|> it's", "fr", "c", 40),
        (9, "Ünïcödé 😀 İstanbul ΣΑΣ <|endoftext|> it's", "fr", "c", 40),
        (10, "one doc_id", "es", "c", 10),
        (10, "with two texts", "es", "c", 14),
        (11, "x" * 300_000, "es", "c", 300_000),
    ]
    return spark.createDataFrame([] if empty else [(*r, *extra) for r in rows], SCHEMA)


def ordered(rows):
    return sorted(rows, key=repr)
