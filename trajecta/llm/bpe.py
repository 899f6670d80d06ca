"""BPE encoding and decoding with a tokenization automaton compiled from the merges.

The automaton reads token sequences.  It starts as one state with a loop for every base
symbol, and each merge (u, v) is applied as a gadget, in the order of the merges: where a
path ``p -u-> q -v-> r`` exists, an arc ``p -uv-> r`` is added, and the arcs labelled u are
led to a copy of q that lacks v.  What it then accepts is exactly one sequence for every
word: the one that the merges give.

All arcs with one label end in one state, so a state is named by its label.  Its row of the
table is the start row without the labels that gadgets took away from it and from the states
it was copied from (those of the label's right parts, as they were when the label was added);
a label goes wherever its left part went when it was added.  The compiled tables are therefore
no longer than the list of merges.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = -1
_END = "\ue000"  # the end-of-word suffix as one symbol
_NEVER = 1 << 62
_MOST_WORDS = 150_000  # encoded words that a worker keeps
_MOST_ARCS = 400_000  # arcs that a worker keeps resolved
_YIELD_BYTES = 2 << 20  # text that goes into one output batch
# Marks, and letters that only came to be composed, which are newer than the library's Unicode tables:
# it takes them for symbols that neither change places with marks nor join a letter.
_NEWER = re.compile(
    "([\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85"
    "\U00011070\U0001133b\U0001145e\U00011839\U0001183a\U00011930\U0001193d\U0001193e\U00011943\U000119e0\U00011a34"
    "\U00011a47\U00011a99\U00011d42\U00011d44\U00011d45\U00011d97\U00011f41\U00011f42\U00016ff0\U00016ff1\U0001e08f"
    "\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef])"
)


class Automaton:
    """Arcs over token ids."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        size = max(vocab.values(), default=-1) + 1
        self.born = [-1] * size  # gadget that added the label
        self.left = [-1] * size
        self.right = [-1] * size
        self.removed: dict[int, int] = {}  # (state, label) -> gadget that took the arc away
        self._known: dict[int, bool] = {}
        dead = set()
        for k, (a, b) in enumerate(merges):
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if u in dead or v in dead or not self._row_has(u, v):
                dead.add(w)  # no path that the gadget could shorten
                continue
            self.born[w], self.left[w], self.right[w] = k, u, v
            self.removed[u << 32 | v] = k
        live = {self._symbols(text, end): i for text, i in vocab.items() if text and i not in dead}
        inner = {symbols[:k] for symbols in live for k in range(len(symbols))}
        # A label that no other one continues is its number alone, which keeps the tree small.
        self.trie: dict = {}
        for symbols, i in live.items():
            node = self.trie
            for symbol in symbols[:-1]:
                node = node.setdefault(symbol, {})
            if symbols in inner:
                node.setdefault(symbols[-1], {})[""] = i
            else:
                node[symbols[-1]] = i

    @staticmethod
    def _symbols(text: str, end: str) -> str:
        """Symbols of a label; the end-of-word suffix counts as one."""
        return text[: -len(end)] + _END if end and text.endswith(end) else text

    def _row_has(self, state: int, label: int) -> bool:
        removed, born, left, right = self.removed, self.born, self.left, self.right
        before = _NEVER  # gadgets from here on came after the state was copied
        while state != START:
            x, until = label, _NEVER
            while True:
                k = removed.get(state << 32 | x)
                if k is not None and k < before and k <= until:
                    return False
                if left[x] < 0:
                    break
                until, x = born[x], left[x]
            before, state = born[state], right[state]
        return True

    def has_arc(self, state: int, label: int) -> bool:
        """Whether ``label`` may follow the label that names ``state``."""
        if state == START:
            return True
        key = state << 32 | label
        known = self._known.get(key)
        if known is None:
            if len(self._known) >= _MOST_ARCS:
                self._known.clear()
            known = self._known[key] = self._row_has(state, label)
        return known

    def encode(self, symbols: str) -> list[int]:
        """Labels on the accepted path over ``symbols``, which close with ``_END`` if the
        vocabulary has an end-of-word suffix.

        The path is looked for with the longest label first.  As every prefix has one accepted
        path only, a place that led nowhere is not entered again.
        """
        n = len(symbols)
        known = self._known
        path: list[int] = []
        places: list[int] = []  # where each label of the path begins
        open_arcs: list[list[int]] = []  # what is left to try at each of these places
        blocked: set[int] = set()
        at, state = 0, START
        arcs = self._labels_from(symbols, 0)
        while at < n:
            while arcs:
                label, to = arcs.pop(), arcs.pop()
                if to in blocked:
                    continue
                may = state == START or known.get(state << 32 | label)
                if may is None:
                    may = self.has_arc(state, label)
                if may:
                    open_arcs.append(arcs)
                    places.append(at)
                    path.append(label)
                    at, state = to, label
                    if at < n:
                        arcs = self._labels_from(symbols, at)
                    break
            else:
                blocked.add(at)
                if not path:
                    raise ValueError(f"no token sequence for {symbols!r}")
                arcs, at = open_arcs.pop(), places.pop()
                path.pop()
                state = path[-1] if path else START
        return path

    def _labels_from(self, symbols: str, at: int) -> list[int]:
        """The place each matching label reaches from ``at`` and the label, in turn, shortest first."""
        found, node = [], self.trie
        for to, symbol in enumerate(symbols[at:], at + 1):
            node = node.get(symbol)
            if node is None:
                break
            if node.__class__ is int:
                found.append(to)
                found.append(node)
                break
            label = node.get("")
            if label is not None:
                found.append(to)
                found.append(label)
        return found


class _Kept(dict):
    """Results by key, of which a bounded number stay; those in use outlive a turn-over."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [chr(b) if b in plain else "" for b in range(256)]
    for k, b in enumerate(b for b in range(256) if b not in plain):
        out[b] = chr(256 + k)
    return out


# White space of the vocabulary's patterns; str.split knows four controls more.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CONTROLS = re.compile("[\x1c-\x1f]")
_GAPS = re.compile(f"[{_SPACE}]+")


def _ranges(kind: str) -> str:
    """Body of a character class with all code points of one Unicode kind (L or N)."""
    inside = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(0x110000)), bool, 0x110000)
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


_L, _N = _ranges("L"), _ranges("N")


def _words(letters: str, numbers: str) -> re.Pattern[str]:
    """Fixed values of the vocabulary: its word pattern, letters first, which begin no other branch."""
    return re.compile(rf"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{_SPACE}{letters}{numbers}]+")


def _low(body: str) -> str:
    """The part of a class's body that is below U+10000."""
    return "".join(r for r in re.findall(r"\\U.{8}-\\U.{8}", body) if int(r[2:10], 16) < 0x10000)


_WORDS = _words(_L, _N)
# Classes are looked up in a table up to U+FFFF and range by range beyond, for a character they lack as well.
_HIGH = re.compile("[\U00010000-\U0010ffff]")
_LOW_WORDS = _words(_low(_L), _low(_N))
_LOW_NEWER = re.compile(re.sub("[\U00010000-\U0010ffff]-?", "", _NEWER.pattern))


def _composed(text: str) -> str:
    """NFC by the library's tables."""
    if text.isascii() or not (_NEWER if _HIGH.search(text) else _LOW_NEWER).search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in _NEWER.split(text))


class Encoder:
    """Encodes whole texts with a vocabulary file of the kind described in ``encode``."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.end = _END if suffix else ""
        self.automaton = Automaton(model["vocab"], [tuple(m) for m in model["merges"]], suffix)
        self.symbols = _byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None
        self.names = {i: t.encode() for t, i in [*model["vocab"].items(), *self.special.items()]}
        # Words, and what stands between two white spaces: a word that stands alone is kept once.
        self.chunks = _Kept(self._encode_chunk, _MOST_WORDS)

    def _encode_word(self, word: str) -> bytes:
        path = self.automaton.encode(word.encode().decode("latin-1").translate(self.symbols) + self.end)
        return struct.pack(f"<{len(path)}I", *path)

    def _encode_chunk(self, chunk: str) -> bytes:
        found = (_LOW_WORDS if chunk.isascii() or not _HIGH.search(chunk) else _WORDS).findall(chunk)
        return self._encode_word(chunk) if found == [chunk] else b"".join(map(self.chunks.__getitem__, found))

    def _plain(self, text: str) -> bytes:
        text = _composed(text).replace("Σ", "σ").lower()  # Σ lowers alike everywhere
        chunks = _GAPS.split(text) if _CONTROLS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none for null."""
        if not text:
            return b""
        if self.marks is None or "<" not in text:
            return self._plain(text)
        return b"".join(
            np.uint32(self.special[part]).astype("<u4").tobytes() if part in self.special else self._plain(part)
            for part in self.marks.split(text)
        )

    def decode(self, ids: bytes) -> bytes:
        """Labels of the path, in UTF-8, joined by spaces as this kind of vocabulary does."""
        return b" ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _give_back() -> None:
    """Hand memory that is no longer used back to the system.

    A worker outlives its task, and those of earlier stages stand idle beside the ones at work.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()


def _encode_batches(batches: Iterator[pa.RecordBatch], definition: str) -> Iterator[pa.RecordBatch]:
    _give_back()
    encoder = Encoder(definition)
    try:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            start, held, ids, decoded = 0, 0, [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                ids.append(encoder.encode(text))
                decoded.append(encoder.decode(ids[-1]))
                held += len(text or "")
                if held >= _YIELD_BYTES or i + 1 == len(texts):
                    columns = batch.slice(start, i + 1 - start).columns[:-1]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                        names=[*batch.schema.names[:-1], "ids", "decoded"],
                    )
                    start, held, ids, decoded = i + 1, 0, [], []
    finally:
        del encoder
        _give_back()


def encode(docs: DataFrame, definition: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``, one row per row of ``docs``.

    ``definition`` is the JSON of a lower-casing word vocabulary: NFC, white space dropped,
    byte symbols, an end-of-word suffix, special tokens matched in the raw text, tokens joined
    by spaces when decoded.  ``ids`` holds little-endian unsigned 32-bit integers and
    ``decoded`` the text that the ids decode to, special tokens included.  A null or blank text
    has no tokens and decodes to the empty text; ids and texts of repeated rows repeat; other
    columns are ignored.  Texts of any length are encoded whole, a few at a time; nothing is
    shuffled.  The definition goes to the tasks; each compiles it once and leaves nothing of it in its worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    schema = "doc_id long, ids binary, decoded string"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(lambda batches: _encode_batches(batches, shared.value), schema)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


def digests(docs: DataFrame, definition: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what ``encode`` gives."""
    return encode(docs, definition).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
