"""Words and hashed word sequences of UTF-8 texts, for use inside tasks.

A word is a run of ``[^\\x20\\x09-\\x0D]``; ``bytes.split`` cuts at exactly those characters
and ``bytes.lower`` lowers exactly A-Z.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash

WORD = r"[^\x20\x09-\x0D]+"

_hash = partial(xxhash.xxh64_intdigest, seed=42)

# Lower-cases A-Z and turns every other ASCII character that is no digit into a space.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32
    for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words; none for null."""
    return text.lower().split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation; none for null."""
    return text.translate(_PLAIN).split() if text else []


def hashes(items: list[bytes]) -> np.ndarray:
    """XXH64 with seed 42 of each item, unsigned."""
    return np.fromiter(map(_hash, items), np.uint64, len(items))


# A multiplier for each byte and each place in a word; none for what separates words.
_rng = np.random.default_rng(0x5EED)
_BYTES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTES[[9, 10, 11, 12, 13, 32]] = 0
_PLACES = _rng.integers(0, 2**63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _word_hashes(data: bytes, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash and start of each word of ``data``, all at once: the sum of byte times place
    multipliers, then mixed.  With ``stem`` also the hashes of the first so many bytes of the
    longer words."""
    raw = np.frombuffer(data, np.uint8)
    factors = _BYTES[raw]
    apart = factors == 0
    starts = np.flatnonzero(~apart & np.r_[True, apart[:-1]]) if len(raw) else np.empty(0, np.int64)
    stems = np.empty(0, np.uint64)
    if not len(starts):
        return stems, starts, stems
    first = starts[0]
    place = np.arange(first, len(raw)) - np.repeat(starts, np.diff(np.r_[starts, len(raw)]))
    with np.errstate(over="ignore"):
        values = factors[first:] * _PLACES[place & (len(_PLACES) - 1)]
        out = mixed(np.add.reduceat(values, starts - first), 77)
        if stem:
            longer = np.add.reduceat(~apart[first:], starts - first, dtype=np.int64) > stem
            values[place >= stem] = 0
            stems = mixed(np.add.reduceat(values, starts - first)[longer], 78)
    return out, starts, stems


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hash of each of ``words(text)``."""
    return _word_hashes(text.lower())[0] if text else np.empty(0, np.uint64)


def all_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each."""
    out, starts, _ = _word_hashes(b"\n".join(texts).lower())
    edges = np.cumsum([len(t) + 1 for t in texts])
    return out, np.diff(np.r_[0, np.searchsorted(starts, edges)])


def plain_hashes(text: bytes | None) -> np.ndarray:
    """Hash of each of ``plain_words(text)``."""
    return _word_hashes(text.translate(_PLAIN))[0] if text else np.empty(0, np.uint64)


def plain_hashes_and_stems(text: bytes | None, stem: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, and hashes of the first ``stem`` bytes of the longer words."""
    out, _, stems = _word_hashes((text or b"").translate(_PLAIN), stem)
    return out, stems


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; another salt is another function."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Order-sensitive hash of every ``width`` neighbouring word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            out ^= out >> np.uint64(29)
    return out
