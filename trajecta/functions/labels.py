"""Display, search and segment labels, as native column expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_TO_END = 2**31 - 1


@cache
def _single_capitals() -> tuple[str, str]:
    """(from, to) for letters whose full capital is several letters but that have a single one."""
    pairs = [("ß", "ẞ")]
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if len(char.upper()) > 1 and len(char.title()) == 1:
            pairs.append((char, char.title()))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def capital(letter: Column) -> Column:
    """One capital for one letter: ``ß`` becomes ``ẞ`` and not ``SS``, ``ﬁ`` stays."""
    full = F.upper(letter)
    return F.when(F.length(full) <= 1, full).otherwise(F.translate(letter, *_single_capitals()))


def lower(text: Column) -> Column:
    """One small letter for one capital: ``İ`` and a final ``Σ`` have context rules in Java."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def title_case(name: Column) -> Column:
    """``JEAN-PIERRE`` to ``Jean-Pierre``; empty segments (``A--B``) survive."""
    capitalised = F.transform(
        F.split(name, "-", -1),
        lambda part: F.concat(
            capital(F.substring(part, 1, 1)), lower(F.substring(part, 2, _TO_END))
        ),
    )
    return F.array_join(capitalised, "-")


@cache
def accent_table() -> tuple[str, str]:
    """(from, to) for ``translate``: every character whose decomposition carries a mark.

    Characters that map to one character come first; the bare combining marks follow and
    have no counterpart, which makes ``translate`` delete them.
    """
    replaced: list[tuple[str, str]] = []
    deleted: list[str] = []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        is_mark = unicodedata.category(char).startswith("M")
        if not is_mark and not unicodedata.decomposition(char):
            continue
        kept = "".join(
            c
            for c in unicodedata.normalize("NFD", char)
            if not unicodedata.category(c).startswith("M")
        )
        bare = unicodedata.normalize("NFC", kept)
        if not bare:
            deleted.append(char)
        elif bare != char and len(bare) == 1:
            replaced.append((char, bare))
    source = "".join(a for a, _ in replaced) + "".join(deleted)
    return source, "".join(b for _, b in replaced)


def strip_accents(text: Column) -> Column:
    """Replace accented letters by their base letter; ligatures and strokes stay."""
    source, target = accent_table()
    return F.translate(text, source, target)


def search_key(name: Column) -> Column:
    """Accent-free lower case, the form a person types in a search box."""
    return lower(strip_accents(name))


def is_search_key(text: Column) -> Column:
    """True where ``text`` is already accent-free and lower case."""
    return (lower(text) == text) & (strip_accents(text) == text)


def group_suffix(grp: Column, first: object = 1, letters: tuple[str, str] = ("M", "F")) -> Column:
    """`` (M)`` for the first group code, `` (F)`` for the other."""
    return F.when(grp == F.lit(first), F.lit(f" ({letters[0]})")).otherwise(f" ({letters[1]})")


def segment_label(display: Column, shared: Column, suffix: Column) -> Column:
    """A label that is unique per (entity, group): the suffix only where a name is shared."""
    return F.when(shared, F.concat(display, suffix)).otherwise(display)
