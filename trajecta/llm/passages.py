"""Substring dedup: repeated passages through compact windows under several min-hash functions.

A token is five words.  Each function hashes the tokens of a text, and the Cartesian tree over the
hashes groups all its runs of 21 tokens and more into compact windows (left, centre, right): every
run between left and right that holds the centre has its least hash there, which is the window's
signature.  Windows of one signature meet across texts.  Within a text the intervals of windows that
met are joined across the functions, and only stretches whose windows met under all of them go on.
So any 25 words in a row that two places share bring them together.  A passage of 50 words or more
whose five-word shingles are similar by 0.8 always has such a run: one change in 50 words leaves 25,
and each further change needs 45 words more.

Places whose surroundings agree word for word link to the first of them.  The others of a key form
a tree: a node holds one place, and a place that goes past it to the left or right with the same
words as another goes to the same child.  A place is compared with the places on its way only, takes
links to those that hold a passage of it, and goes on while a child may hold more.  Passages with
changed words are looked for among more words on either side.  What the links name is then verified
in the whole texts: matching runs are chained across diagonals, and the similarity is taken over the
joined span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.columns import small_batches, unused
from trajecta.llm.words import all_word_hashes, mixed, shingle_hashes, word_hashes
from trajecta.session import materialise

MIN_WORDS = 50
SHINGLE = 5
SIMILARITY = 0.8
COMMON = 25  # words in a row that every passage shares at least
WIDTH = COMMON - SHINGLE + 1  # tokens of the shortest run that a window groups
FUNCTIONS = 2  # all of which must agree
_AROUND = 48  # words on either side of a token that are compared first; a passage of 50 words fits
_BESIDE = 108  # words on either side that two runs under 50 take with up to 14 words put in between
_CONTEXT = 2 * _BESIDE + SHINGLE
_FIRST, _LAST = _BESIDE - _AROUND, _BESIDE + SHINGLE + _AROUND  # of the words that are compared first
_NEAR = 19  # words beyond a difference in which two places agree again: 14 put in, and a shingle
_MATCHED = 41  # shingles that two passages of 50 words share at least, if similar enough
_CHUNK_BYTES = 1 << 20
_BATCH_ROWS = 2000
_PLACES_ROWS = 4096  # places and their words that are handed on at a time
_LOW = np.uint64((1 << 20) - 1)
_LINK = np.dtype([(c, "<i8") for c in ("doc", "ver", "at", "p_doc", "p_ver", "p_at")])
_LINK_SCHEMA = ", ".join(f"{c} long" for c in _LINK.names)
# Names of the sides and places at which the tree of a key branches.
_RIGHT, _LEFT, _RIGHT_CHANGED, _LEFT_CHANGED = ([bytes((side, k)) for k in range(_CONTEXT + 1)] for side in range(4))
_POWER = 0x9E3779B97F4A7C15


def _least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all places, and whether each is a wall or least in some stretch of ``width``."""
    n = len(values)
    place = np.arange(n, dtype=np.uint64)
    key = np.where(values == 0, np.uint64(0), (values | (_LOW + np.uint64(1))) & ~_LOW) | (place & _LOW)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    full[:n] = key
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    start = place[: n - width + 1]
    least = np.minimum(behind[: len(start)], ahead[width - 1 : width - 1 + len(start)])
    chosen = values == 0
    chosen[(start + (((least & _LOW) - start) & _LOW)).astype(np.int64)] = True
    return key, chosen


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(left, centre, right)`` of all compact windows with at least ``width`` places.

    A zero in ``values`` is a wall that no window crosses.  Equal values count from the left.
    Only places that are least in some stretch of ``width`` can be centres, and so can the walls
    of their windows; the tree is built over those.
    """
    n = len(values)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none
    key, chosen = _least(values, width)
    at = np.flatnonzero(chosen)
    keys, places = key[at].tolist(), at.tolist()
    before, after = [-1] * len(places), [n] * len(places)
    stack: list[int] = []
    for i, k in enumerate(keys):
        while stack and keys[stack[-1]] > k:
            after[stack.pop()] = places[i]
        if stack:
            before[i] = places[stack[-1]]
        stack.append(i)
    centre = values[at] != 0
    return np.array(before)[centre] + 1, at[centre], np.array(after)[centre] - 1


def _window_rows(texts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """key, around, n, doc, ver, at, span of all windows of ``(doc, ver, text)``.

    The key is the signature, with the function's number in its last bits.  ``around`` tells the
    words up to ``_AROUND`` places beside the centre ``at``, and where the text ends.  ``span`` packs
    how far before the centre the window's shortest runs begin, first and last.
    """
    h, sizes = all_word_hashes([t for _, _, t in texts])
    starts = np.cumsum(np.r_[0, sizes])[:-1]
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = (starts + sizes)[owner]
    tokens = shingle_hashes(h, SHINGLE)
    wall = np.arange(len(tokens)) + SHINGLE > ends[: len(tokens)]
    keys, centres, spans = [], [], []
    for f in range(FUNCTIONS):
        values = mixed(tokens, f) | np.uint64(1)
        values[wall] = 0
        left, centre, right = compact_windows(values, WIDTH)
        first, last = np.maximum(left, centre - WIDTH + 1), np.minimum(centre, right - WIDTH + 1)
        keys.append((values[centre] & ~np.uint64(3)) | np.uint64(f))
        centres.append(centre)
        spans.append((centre - first) << 8 | (centre - last))
    key, c, span = map(np.concatenate, (keys, centres, spans))
    begin = np.maximum(c - _AROUND, starts[owner[c]])
    end = np.minimum(c + SHINGLE + _AROUND, ends[c])
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[1, np.full(len(h), _POWER, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[1, np.full(len(h), pow(_POWER, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        sums = np.r_[np.uint64(0), np.cumsum(h * up[:-1], dtype=np.uint64)]
        around = mixed((sums[end] - sums[begin]) * down[begin], 1) + ((c - begin) << 32 | (end - c)).astype(np.uint64)
    docs = np.array([d for d, _, _ in texts], np.int64)[owner[c]]
    vers = np.array([v for _, v, _ in texts], np.int64)[owner[c]]
    around = mixed(around, 2).view(np.int64)
    return key.view(np.int64), around, sizes[owner[c]], docs, vers, c - starts[owner[c]], span


def _linked(key, around, n, doc, ver, at, span, held=None):
    """Links of rows sorted by key and surroundings to the first of the same, which rows are
    first, and the last first row.

    ``held`` is the last first row of an earlier table that this one goes on from.
    """
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (around[1:] != around[:-1])
    if held is not None and len(key) and (key[0], around[0]) == held[:2]:
        new[0] = False
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
    old = held or (0,) * 6
    p = [np.where(head >= 0, c[head], old[i]) for i, c in ((3, doc), (4, ver), (5, at))]
    take = ~new & ((doc != p[0]) | (ver != p[1]) | (at != p[2]))
    links = np.empty(int(take.sum()), _LINK)
    links["doc"], links["ver"], links["at"] = doc[take], ver[take], at[take]
    for name, column in zip(("p_doc", "p_ver", "p_at"), p):
        links[name] = column[take]
    last = int(head[-1]) if len(key) else -1
    return links, new, (tuple(int(c[last]) for c in (key, around, n, doc, ver, at)) if last >= 0 else held)


def _order(columns: tuple[np.ndarray, ...]) -> np.ndarray:
    """Order by all columns; the later ones are looked at only where the first repeats."""
    order = np.argsort(columns[0])
    first = columns[0][order]
    same = first[1:] == first[:-1]
    ties = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    rows = order[ties]
    order[ties] = rows[np.lexsort([c[rows] for c in columns[::-1]])]
    return order


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window that is the first of its key and surroundings in its chunk of texts;
    the links of the others travel packed, in one row per chunk."""

    def rows(chunk):
        columns = _window_rows(chunk)
        order = _order(columns)
        columns = [c[order] for c in columns]
        links, new, _ = _linked(*columns)
        columns = [c[new] for c in columns]
        packed = [None] * len(columns[0])
        if len(links):
            spread = int(mixed(columns[0][:1].view(np.uint64), 99).view(np.int64)[0])
            columns = [np.append(c, x) for c, x in zip(columns, (spread, 0, 0, 0, 0, 0, 0))]
            packed.append(links.tobytes())
        names = ["key", "around", "n", "doc", "ver", "at", "span", "links"]
        arrays = [pa.array(c.astype(np.int64)) for c in columns]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(packed, pa.binary())], names=names)

    for batch in batches:
        ids, vers, texts = batch.columns
        chunk, held = [], 0
        for i in range(len(batch)):
            text = texts[i].as_py().encode()
            if len(text) >= 2 * MIN_WORDS - 1:
                chunk.append((ids[i].as_py(), vers[i].as_py(), text))
                held += len(text)
            if held >= _CHUNK_BYTES or (chunk and i + 1 == len(batch)):
                yield rows(chunk)
                chunk, held = [], 0


_MET_SCHEMA = f"key long, span long, {_LINK_SCHEMA}"


def _link_table(links: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(links[c]) for c in _LINK.names], names=list(_LINK.names))


def _met_table(links: np.ndarray) -> pa.RecordBatch:
    columns = [*[pa.nulls(len(links), pa.int64())] * 2, *_link_table(links).columns]
    return pa.RecordBatch.from_arrays(columns, names=["key", "span", *_LINK.names])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of windows that come sorted by key and surroundings; and with their key, without a
    partner, the first windows of keys that stand in several surroundings."""
    held = None
    waiting, shared = [np.empty(0, np.int64)] * 5, False  # a first row whose successor is not known

    def firsts(columns, take):
        columns = [c[take] for c in columns]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), *[pa.nulls(len(columns[0]), pa.int64())] * 3], names=["key", "span", *_LINK.names]
        )

    for batch in batches:
        packed = batch.column(7)
        for x in packed.drop_null():
            yield _met_table(np.frombuffer(x.as_py(), _LINK))
        plain = batch.filter(packed.is_null())
        columns = [plain.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        links, new, held = _linked(*columns, held)
        if len(links):
            yield _met_table(links)
        rows = [np.concatenate([w, columns[i][new]]) for w, i in zip(waiting, (0, 6, 3, 4, 5))]
        if not len(rows[0]):
            continue
        same = rows[0][1:] == rows[0][:-1]
        both = np.r_[same, False] | np.r_[shared and len(waiting[0]) > 0, same]
        waiting, shared = [c[-1:] for c in rows], bool(both[-1])
        both[-1] = False
        if both.any():
            yield firsts(rows, both)
    if shared:
        yield firsts(waiting, np.ones(1, bool))


def joined(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all pairs of intervals ``(low, high)`` that overlap; those of one side come in
    order and do not overlap each other."""
    low = np.searchsorted(second[1], first[0])
    count = np.maximum(np.searchsorted(second[0], first[1], "right") - low, 0)
    i = np.repeat(np.arange(len(low)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + low[i]


def _agreed(key: np.ndarray, at: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the first function and centres of the windows of one text that met, as did
    windows of all other functions over the same stretch."""
    order = np.lexsort((at, key & 3))
    key, at, span = key[order], at[order], span[order]
    low, high = at - (span >> 8), at - (span & 255)
    own = [np.flatnonzero((key & 3) == f) for f in range(FUNCTIONS)]
    window, ends = own[0], (low[own[0]], high[own[0]])
    for places in own[1:]:
        i, j = joined(ends, (low[places], high[places]))
        ends = np.maximum(ends[0][i], low[places[j]]), np.minimum(ends[1][i], high[places[j]])
        window = window[i]
    window = np.unique(window)
    return key[window], at[window]


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``key, n, doc, ver, at, words``: 16 bits for each word around a place, 0 beyond the text."""
    around = np.arange(_CONTEXT)

    def rows(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        *columns, words = map(np.concatenate, zip(*parts))
        edges = pa.array(np.arange(len(words) + 1) * 2 * _CONTEXT, pa.int32())
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, edges.buffers()[1], pa.py_buffer(words)])
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), packed], names=["key", "n", "doc", "ver", "at", "words"]
        )

    parts, held = [], 0
    for batch in batches:
        docs, vers = (batch.column(i).to_pylist() for i in range(2))
        places, texts = batch.column(2), batch.column(3)
        fields = [x.to_numpy(zero_copy_only=False) for x in places.flatten().flatten()]
        edges = np.cumsum(np.r_[0, places.value_lengths().to_numpy(zero_copy_only=False)]).tolist()
        for i, (doc, ver) in enumerate(zip(docs, vers)):
            key, at = _agreed(*(f[edges[i] : edges[i + 1]] for f in fields))
            if not len(key):
                continue
            h = word_hashes(texts[i].as_py().encode())
            short = np.zeros(len(h) + _CONTEXT, np.uint16)
            short[_BESIDE : _BESIDE + len(h)] = np.maximum(h >> np.uint64(48), np.uint64(1))
            for k in range(0, len(at), _PLACES_ROWS):
                some = at[k : k + _PLACES_ROWS]
                fixed = [np.full(len(some), x, np.int64) for x in (len(h), doc, ver)]
                parts.append((key[k : k + _PLACES_ROWS], *fixed, some, short[some[:, None] + around]))
                held += len(some)
                if held >= _PLACES_ROWS:
                    yield rows(parts)
                    parts, held = [], 0
    if parts:
        yield rows(parts)


class _Place:
    """A place of a key, and the places that went past it with other words.

    The words to the right of the centre and to the left of it, outwards, are kept as numbers too:
    how far two of them agree is then told by one exclusive or.
    """

    __slots__ = ("name", "words", "right", "left", "low", "high", "children")

    def __init__(self, name: tuple, words: bytes, outwards: bytes, low: int, high: int):
        self.name, self.words = name, words
        self.right, self.left = int.from_bytes(words[2 * _BESIDE : 2 * _LAST], "big"), int.from_bytes(outwards, "big")
        self.low, self.high = low, high  # where the text begins and ends
        self.children: dict[bytes, _Place] | None = None

    def hashes(self) -> np.ndarray:
        return np.frombuffer(self.words, np.uint16)[self.low : self.high].astype(np.uint64)

    def shingles(self) -> set[bytes]:
        w = self.words
        return {w[i : i + 2 * SHINGLE] for i in range(2 * self.low, 2 * (self.high - SHINGLE) + 1, 2)}

    def goes_on(self, other: _Place, end: int, step: int) -> bool:
        """Whether both share a shingle again within a few words of ``end``, to the right (1) or left (-1)."""
        low, high = (end, end + _NEAR) if step > 0 else (end - _NEAR, end)
        a, b = (p.words[2 * max(low, p.low) : 2 * min(high, p.high)] for p in (self, other))
        size = 2 * SHINGLE
        known = {a[i : i + size] for i in range(0, len(a) - size + 1, 2)}
        return any([b[i : i + size] in known for i in range(0, len(b) - size + 1, 2)]) if known else False


def _aligned(a: _Place, b: _Place) -> tuple[int, int]:
    """Start and end of the longest similar span around the centre, word against word at the same
    distance from it."""
    x, y = (np.frombuffer(p.words, np.uint16) for p in (a, b))
    equal = np.zeros(len(x) + 2, bool)
    equal[1:-1] = (x == y) & (x != 0)
    edges = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2)
    runs = edges[edges[:, 1] - edges[:, 0] >= SHINGLE]
    upto = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(runs[:, 1] - runs[:, 0] - SHINGLE + 1, out=upto[1:])
    own = int(np.searchsorted(runs[:, 0], _BESIDE, "right"))  # runs up to the one at the centre
    matched = upto[own:][None] - upto[:own][:, None]
    length = runs[own - 1 :, 1][None] - runs[:own, 0][:, None]
    best = np.where(_similar(matched, length, length) >= SIMILARITY, length, -1)
    i, j = divmod(int(best.argmax()), best.shape[1])
    return int(runs[i, 0]), int(runs[own - 1 + j, 1])


def _may_go_on(a: bytes, b: bytes, start: int, end: int) -> bool:
    """False only if neither side of the run from ``start`` to ``end`` goes on, without the shingles:
    of ``_NEAR`` words, every shingle holds the fifth, the tenth or the fifteenth."""
    s, e = 2 * start, 2 * end
    ahead = b[e : e + 2 * _NEAR]
    if a[e + 8 : e + 10] in ahead or a[e + 18 : e + 20] in ahead or a[e + 28 : e + 30] in ahead or start < _NEAR:
        return True
    back = b[s - 2 * _NEAR : s]
    return a[s - 10 : s - 8] in back or a[s - 20 : s - 18] in back or a[s - 30 : s - 28] in back


def _changed(a: _Place, b: _Place, start: int, end: int, known: list[set[bytes]]) -> list[tuple[int, int]]:
    """Passages with changed words that two places share around a run from ``start`` to ``end``
    which is none by itself, as places of ``a``.

    The shingles of ``a`` are kept in ``known`` by the caller, while it looks at ``a``; those of all
    places of a key would take more memory than the places.
    """
    if not (a.goes_on(b, end, 1) or a.goes_on(b, start, -1)):
        return []
    if not known:
        known.append(a.shingles())
    if len(known[0]) < _MATCHED or len(known[0] & b.shingles()) < _MATCHED:
        return []
    found = _aligned(a, b)
    if found[1] - found[0] >= MIN_WORDS:
        return [found]
    # Words may be inserted or left out.
    anchor = (_BESIDE - a.low, _BESIDE - b.low)
    return [(a.low + s, a.low + e) for s, e, *_ in verified(a.hashes(), b.hashes(), [anchor])]


def _descend(root: _Place, own: _Place) -> list[tuple]:
    """Names of the places in the tree that hold passages of ``own``, which then joins the tree.

    A place that agrees with a node from ``start`` to ``end`` takes the children that agree with it
    further: they have the same words there, one at least, and as many on one of the sides as both
    together need to come to ``COMMON``.  If they have come to it, the next word may also be changed
    in all three.  A child's name is the side and place, one letter each, and the words.

    A child is entered only if it may hold words beyond those that the places before it hold.
    """
    low, high = _CONTEXT, 0
    out, open_nodes, seen = [], [root], set()
    known: list[set[bytes]] = []
    before = 16 * _FIRST + 15
    words, right, left, own_low, own_high = own.words, own.right, own.left, max(own.low, _FIRST), min(own.high, _LAST)
    while open_nodes:
        node = open_nodes.pop()
        if node in seen:
            continue
        seen.add(node)
        # First and last place of the words around the centre that both share.
        start = ((left ^ node.left).bit_length() + before) >> 4
        end = _LAST - (((right ^ node.right).bit_length() + 15) >> 4)
        if start < own_low:
            start = own_low
        if start < node.low:
            start = node.low
        if end > own_high:
            end = own_high
        if end > node.high:
            end = node.high
        run = end - start
        if run >= MIN_WORDS:
            if start < low or end > high:
                out.append((start, end, run, node.name))
                low, high = min(low, start), max(high, end)
        elif run >= COMMON and (not known or len(known[0]) >= _MATCHED) and _may_go_on(words, node.words, start, end):
            for s, e in _changed(own, node, start, end, known):
                if s < low or e > high:
                    out.append((s, e, run, node.name))
                    low, high = min(low, s), max(high, e)
        children = node.children
        if children is None:
            children = node.children = {}
        more = 1 if run >= COMMON - 1 else (COMMON - run + 1) // 2
        if end < own_high:
            way = _RIGHT[end] + words[2 * end : 2 * (end + more)]
            child = children.setdefault(way, own)
            if child is not own and (not high or end >= high):
                open_nodes.append(child)
        if start > own_low:
            way = _LEFT[start] + words[2 * (start - more) if start > more else 0 : 2 * start]
            child = children.setdefault(way, own)
            if child is not own and (not high or start <= low):
                open_nodes.append(child)
        if run >= COMMON:
            if end + 4 <= own_high:
                way = _RIGHT_CHANGED[end] + words[2 * end + 2 : 2 * end + 8]
                child = children.setdefault(way, own)
                if child is not own and (not high or end >= high):
                    open_nodes.append(child)
            if start - 4 >= own_low:
                way = _LEFT_CHANGED[start] + words[2 * start - 8 : 2 * start - 2]
                child = children.setdefault(way, own)
                if child is not own and (not high or start <= low):
                    open_nodes.append(child)
    # Later places hold more; of the earlier ones those stay that reach beyond their runs.  What holds
    # a passage with changed words replaces none, as the whole texts may tell otherwise.
    low, high, names = _CONTEXT, 0, []
    for start, end, run, name in reversed(out):
        if start < low or end > high:
            names.append(name)
            if run >= MIN_WORDS:
                low, high = min(low, start), max(high, end)
    return names


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows of ``_surroundings``, sorted by key, to earlier rows of their key."""
    key, root = None, None
    for batch in batches:
        keys, docs, vers, ats = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        packed = batch.column(5)
        rows = np.frombuffer(packed.buffers()[2], np.uint16, len(batch) * _CONTEXT, packed.offset * 2 * _CONTEXT)
        rows = rows.reshape(len(batch), _CONTEXT)
        outwards = np.ascontiguousarray(rows[:, _FIRST : _BESIDE + SHINGLE][:, ::-1]).tobytes()
        inwards, size = rows.tobytes(), 2 * (_AROUND + SHINGLE)
        lows, highs = (rows != 0).argmax(axis=1).tolist(), (_CONTEXT - (rows[:, ::-1] != 0).argmax(axis=1)).tolist()
        keys, docs, vers, ats = (x.tolist() for x in (keys, docs, vers, ats))

        def place(k: int) -> _Place:
            name = (docs[k], vers[k], ats[k])
            words = inwards[2 * _CONTEXT * k : 2 * _CONTEXT * (k + 1)]
            return _Place(name, words, outwards[size * k : size * (k + 1)], lows[k], highs[k])

        found: list[tuple] = []
        for k in range(len(batch)):
            if keys[k] != key:
                key, root = keys[k], place(k)
            else:
                own = place(k)
                found += [own.name + other for other in _descend(root, own)]
        if found:
            yield _link_table(np.array(found, _LINK))


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Number of places from the start at which two arrays agree."""
    n, k, step = min(len(a), len(b)), 0, 32
    while k < n:
        same = a[k : min(k + step, n)] == b[k : min(k + step, n)]
        if not same.all():
            return k + int(same.argmin())
        k, step = k + step, step * 4
    return n


def _next_run(x: np.ndarray, y: np.ndarray, reach: int) -> tuple[int, int] | None:
    """Fewest words to pass over in both, at most ``reach`` in each, up to a common shingle of those
    that begin at the words of both."""
    size = min(_NEAR, reach)
    i, j = (x[: size + 1, None] == y[: size + 1]).nonzero()
    if len(i):
        k = int((i + j).argmin())
        if i[k] + j[k] <= size or size == reach:
            return int(i[k]), int(j[k])
    while size < reach:
        size = min(size * 8, reach)
        order = np.argsort(y[: size + 1], kind="stable")
        known = y[order]
        at = np.minimum(np.searchsorted(known, x[: size + 1]), len(known) - 1)
        i = np.flatnonzero(known[at] == x[: size + 1])
        j = order[at[i]]
        if len(i):
            k = int(np.lexsort((x[i], i + j))[0])
            if i[k] + j[k] <= size or size == reach:
                return int(i[k]), int(j[k])
    return None


def _chain(
    a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, shared: np.ndarray,
    matched: int, len_a: int, len_b: int, spare: int,
) -> np.ndarray:
    """Rows of words gained on each side beyond a mismatch, and shingles matched with them, after
    each further run; the first row is none.

    ``x`` and ``y`` are the shingles at the words of ``a`` and ``b``, ``shared`` tells which of the former
    are among all of the latter; ``matched``, ``len_a`` and
    ``len_b`` describe the run so far, ``spare`` the words that may match on its other side.  The chain ends where no passage can be similar enough any more.
    """
    i = j = gained = 0
    out = [(0, 0, 0)]
    while True:
        rest = min(len(a) - i, len(b) - j)
        hope = matched + gained + rest + spare
        lost = len_a + i + len_b + j - 2 * (SHINGLE - 1) - 2 * (matched + gained)
        reach = min(rest, int(hope * (1 / SIMILARITY - 1)) - lost)
        step = None
        if rest >= SHINGLE and reach > 0 and shared[i : i + reach + 1].any():
            step = _next_run(x[i:], y[j:], reach)
        if step is None:
            return np.array(out)
        run = _agreeing(a[i + step[0] :], b[j + step[1] :])
        i, j, gained = i + step[0] + run, j + step[1] + run, gained + run - SHINGLE + 1
        out.append((i, j, gained))


def _similar(matched, len_a, len_b):
    """Jaccard similarity of the shingles of two aligned passages, at least."""
    return matched / np.maximum(1, len_a + len_b - 2 * (SHINGLE - 1) - matched)


def verified(a: np.ndarray, b: np.ndarray, anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int, float]]:
    """``(start, end, b_start, b_end, similarity)`` of the passages around ``anchors``.

    ``a`` and ``b`` are word hashes; an anchor is a place in each, and anchors come by diagonal.
    Words equal on both sides of the anchor are taken first, then runs further out on either side
    are chained to them, on any diagonal, and the longest span whose five-word shingles are
    similar enough is the passage.  Passages under ``MIN_WORDS`` on either side are dropped.
    """
    out, done = {}, {}
    x, y = shingle_hashes(a, SHINGLE), shingle_hashes(b, SHINGLE)
    known = np.sort(y)
    shared = known[np.minimum(np.searchsorted(known, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)
    for i, j in anchors:
        if any(s <= i < e and bs <= j < be for s, e, bs, be in done.get((i - j) >> 4, ())):
            continue
        right = _agreeing(a[i:], b[j:])
        if right < SHINGLE:
            continue
        left = _agreeing(a[:i][::-1], b[:j][::-1])
        s, e, bs, be = i - left, i + right, j - left, j + right
        matched, n = left + right - SHINGLE + 1, left + right
        before, after = min(s, bs), min(len(a) - e, len(b) - be)
        ahead = _chain(a[e:], b[be:], x[e:], y[be:], shared[e:], matched, n, n, before)
        # Read backwards, a shingle stands at its last word.
        s_end, b_end = max(0, s - SHINGLE + 1), max(0, bs - SHINGLE + 1)
        behind = _chain(
            a[:s][::-1], b[:bs][::-1], x[:s_end][::-1], y[:b_end][::-1], shared[:s_end][::-1], matched, n, n, after
        )
        more_a, more_b, m = (ahead[:, None] + behind[None]).transpose(2, 0, 1)
        similarity = _similar(matched + m, n + more_a, n + more_b)
        k, l = divmod(int(np.where(similarity >= SIMILARITY, more_a + more_b, -1).argmax()), len(behind))
        e, be, s, bs = e + int(ahead[k, 0]), be + int(ahead[k, 1]), s - int(behind[l, 0]), bs - int(behind[l, 1])
        for near in {(s - bs) >> 4, (e - be) >> 4, (i - j) >> 4}:
            done.setdefault(near, []).append((s, e, bs, be))
        if min(e - s, be - bs) >= MIN_WORDS:
            out[s, e, bs, be] = float(similarity[k, l])
    return [(*span, similarity) for span, similarity in out.items()]


_PASSAGE = ["doc", "ver", "start", "end", "p_doc", "p_ver", "p_start", "p_end", "similarity"]
_PASSAGE_SCHEMA = ", ".join(f"{c} {'double' if c == 'similarity' else 'long'}" for c in _PASSAGE)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of pairs of texts, which come by document.

    Partners that share more places come first; places all of whose surroundings are inside passages
    that earlier partners were found to hold are not looked at again.
    """
    last: tuple[tuple, np.ndarray] = ((), np.empty(0, np.uint64))
    held = np.empty(0, bool)  # words of the document in passages found so far
    for batch in batches:
        out: list[tuple] = []
        ids = [batch.column(i).to_pylist() for i in range(4)]
        links, text, p_text = batch.column(4), batch.column(5), batch.column(6)
        fields = [x.to_numpy(zero_copy_only=False) for x in links.flatten().flatten()]
        edges = np.cumsum(np.r_[0, links.value_lengths().to_numpy(zero_copy_only=False)])
        for i in range(len(batch)):
            own, other = (ids[0][i], ids[1][i]), (ids[2][i], ids[3][i])
            if last[0] != own:
                last = (own, word_hashes(text[i].as_py().encode()))
                held = np.zeros(len(last[1]), bool)
            a = last[1]
            at, p_at = (f[edges[i] : edges[i + 1]] for f in fields)
            upto = np.r_[0, np.cumsum(held)]
            low, high = np.maximum(at - _BESIDE, 0), np.minimum(at + SHINGLE + _BESIDE, len(a))
            new = upto[high] - upto[low] < high - low
            if not new.any():
                continue
            b = a if own == other else word_hashes(p_text[i].as_py().encode())
            if own != other and len(a) == len(b) and (a == b).all():
                out.append((*own, 0, len(a), *other, 0, len(b), 1.0))
                held[:] = True
                continue
            anchors = sorted(set(zip(at[new].tolist(), p_at[new].tolist())), key=lambda x: (x[0] - x[1], x[0]))
            for s, e, bs, be, similarity in verified(a, b, anchors):
                out.append((*own, s, e, *other, bs, be, similarity))
                held[s:e] = True
        columns = list(zip(*out)) or [[]] * len(_PASSAGE)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.float64() if n == "similarity" else pa.int64()) for c, n in zip(columns, _PASSAGE)], names=_PASSAGE
        )


def _named(docs: DataFrame) -> DataFrame:
    """``doc, ver, text``: ver tells texts apart that share a doc_id."""
    return docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc"), F.hash("text").cast("long").alias("ver"), "text"
    )


def _found(docs: DataFrame) -> DataFrame:
    """Verified passages, by (doc, ver)."""
    named = _named(docs)
    windows = named.mapInArrow(
        _windows, "key long, around long, n long, doc long, ver long, at long, span long, links binary"
    )
    met = materialise(
        windows.repartition("key")
        .sortWithinPartitions("key", "around", "n", "doc", "ver", "at")
        .mapInArrow(_meet, _MET_SCHEMA),
        "met",
    )
    # Windows of signatures that stand in several surroundings: only there are the words themselves needed.
    places = met.filter("key IS NOT NULL").groupBy("doc", "ver").agg(F.collect_list(F.struct("key", "at", "span")).alias("places"))
    once = named.dropDuplicates(["doc", "ver"])
    compared = (
        places.join(once, ["doc", "ver"])
        .select("doc", "ver", "places", "text")
        .mapInArrow(_surroundings, "key long, n long, doc long, ver long, at long, words binary")
        .repartition("key")
        .sortWithinPartitions("key", "n", "doc", "ver", "at")
        .mapInArrow(_compare, _LINK_SCHEMA)
    )
    links = met.filter("key IS NULL").drop("key", "span").union(compared)
    pair = ["doc", "ver", "p_doc", "p_ver"]
    pairs = materialise(links.groupBy(*pair).agg(F.collect_list(F.struct("at", "p_at")).alias("links")), "pairs")
    ends = pairs.select("doc", "ver").union(pairs.select("p_doc", "p_ver")).distinct()
    # Texts that take part, each once.
    texts = materialise(named.join(ends, ["doc", "ver"], "left_semi").dropDuplicates(["doc", "ver"]), "texts")
    other = texts.select(F.col("doc").alias("p_doc"), F.col("ver").alias("p_ver"), F.col("text").alias("p_text"))
    # A first window's document is the shortest of its key, so the text added here is no longer than its partner's.
    both = pairs.join(other, ["p_doc", "p_ver"]).join(texts, ["doc", "ver"]).select(*pair, "links", "text", "p_text")
    ordered = both.sortWithinPartitions("doc", "ver", F.size("links").desc(), "p_doc", "p_ver")
    return ordered.mapInArrow(_verify, _PASSAGE_SCHEMA)


def _written(docs: DataFrame) -> DataFrame:
    """``_found``, with a few texts at a time in a task."""
    with small_batches(docs.sparkSession, _BATCH_ROWS):
        return materialise(_found(docs), "passages")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, start, end, match_doc_id, match_start, match_end, similarity)``.

    One row for each passage of at least ``MIN_WORDS`` words (places in words, end excluded)
    that a shorter document, one as long with a smaller doc_id, or an earlier place of the same
    document holds as well, word for word or with a five-word shingle similarity of 0.8 or more.
    Places with the same 48 words on either side link to the first of them, those that are read
    together among themselves first; a place that differs takes those that hold more of its words than
    the ones before.  So an exact group of any size gives as many rows as it has repeats.

    Documents with a null doc_id or text and texts under ``MIN_WORDS`` words have no rows.  Rows
    alike in doc_id and text are one document, and do not repeat each other; a doc_id with two
    texts is two documents.  Long texts are taken whole.  Other columns are ignored.
    """
    found = _written(docs)
    return found.select(
        F.col("doc").alias("doc_id"), "start", "end", F.col("p_doc").alias("match_doc_id"),
        F.col("p_start").alias("match_start"), F.col("p_end").alias("match_end"), "similarity",
    )


_WORD_PLACES = re.compile(rb"[^\x20\x09-\x0D]+")


def cut(text: bytes | None, spans: list[dict] | None) -> str | None:
    """``text`` without the words in ``spans``; null if no word is left."""
    if text is None or spans is None:
        return None
    places = [m.start() for m in _WORD_PLACES.finditer(text)]
    gone = np.zeros(len(places) + 1, np.int64)
    for span in spans:
        gone[span["start"]] += 1
        gone[span["end"]] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    if not keep.any():
        return None
    # Runs of kept words, each with the white space up to the next word.
    edge = np.flatnonzero(np.diff(np.r_[False, keep, False].astype(np.int8)))
    ends = [*places, len(text)]
    head = text[: places[0]] if keep[0] else b""
    return (head + b"".join(text[ends[i] : ends[j]] for i, j in zip(edge[::2], edge[1::2]))).decode()


def _cut_batch(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([cut(t, s) for t, s in zip(text, spans)], dtype=object)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, columns and all, with each repeated passage left at its first place only.

    The words of every other place are cut out with the white space after them; a document of
    which nothing but white space is left goes.  Documents without repeats, and those without a
    doc_id or text, stay as they are.
    """
    key, ver, spans = unused(docs, "doc"), unused(docs, "ver"), unused(docs, "spans")
    found = _written(docs)
    cuts = found.groupBy(F.col("doc").alias(key), F.col("ver").alias(ver)).agg(
        F.collect_list(F.struct("start", "end")).alias(spans)
    )
    joined = docs.join(
        cuts, (F.col("doc_id") == F.col(key)) & (F.hash("text").cast("long") == F.col(ver)), "left"
    )
    has = F.col(spans).isNotNull()
    cut_spans = F.pandas_udf(_cut_batch, "string")
    text = F.when(has, cut_spans(F.when(has, F.col("text").cast("binary")), F.col(spans))).otherwise(F.col("text"))
    cut_text = unused(docs, "cut")
    return (
        joined.withColumn(cut_text, text)
        .filter(~has | F.col(cut_text).isNotNull())
        .select(*[F.col(cut_text).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    )
