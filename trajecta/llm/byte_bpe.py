"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut first, at places where the word pattern ends a match in any case, so a task
holds the tokens of a part and never those of a whole table.  Decoding joins the bytes of the
tokens; no token need hold a whole character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 16  # characters after which a text is cut at the next safe place
_YIELD_BYTES = 2 << 20  # text that goes into one output batch

# Between a character that is no white space and a blank, tab or line feed.  A match that holds
# the first cannot hold the second: only a match's first character, or all of it, is white space.
# What follows does not look back.  Python's \s has all white space of the library and a few more.
_SAFE = re.compile(r"(?<=\S)(?=[ \t\n])")


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters (but for the last), cut at safe places
    only; one without such a place stays whole."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a file with a token in base64 and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Encoder:
    """Encodes and decodes whole texts; special tokens are ordinary text."""

    def __init__(self, lines: bytes, pattern: str):
        self.library = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=read_ranks(lines), special_tokens={}
        )

    def encode(self, text: str | None) -> np.ndarray:
        """Ids; none for null."""
        if not text:
            return np.empty(0, np.int32)
        found = [self.library.encode_ordinary(part) for part in parts(text)]
        return np.concatenate([np.array(ids, np.int32) for ids in found])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.library.decode_bytes(ids.tolist())


_made: dict[tuple[bytes, str], Encoder] = {}  # of this worker


def _encoder(lines: bytes, pattern: str) -> Encoder:
    if (lines, pattern) not in _made:
        _made.clear()
        _made[lines, pattern] = Encoder(lines, pattern)
    return _made[lines, pattern]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    edges = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(rows), pa.int32()))


def _encode_batches(batches: Iterator[pa.RecordBatch], encoder: Encoder) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        start, held, ids, decoded = 0, 0, [], []
        for i in range(len(texts)):
            text = texts[i].as_py()
            ids.append(encoder.encode(text))
            decoded.append(encoder.decode(ids[-1]))
            held += len(decoded[-1])
            if held >= _YIELD_BYTES or i + 1 == len(texts):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, i + 1 - start), _lists(ids), pa.array(decoded, pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )
                start, held, ids, decoded = i + 1, 0, [], []


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``, one row per row of ``docs``.

    ``ranks`` is the content of a rank file and ``pattern`` cuts a text into words; each match is
    encoded by itself.  ``ids`` is an array of int and ``decoded`` the bytes of the ids.  A null or
    empty text has no tokens.  Repeated rows repeat; a null doc_id stays null; other columns are
    ignored; an empty table gives no rows.  Texts of any length are encoded whole, a few at a
    time; nothing is shuffled.  The rank file, whose size does not depend on the documents, goes to
    the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = rows.mapInArrow(
        lambda batches: _encode_batches(batches, _encoder(*shared.value)), "doc_id long, ids array<int>, decoded binary"
    )
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


def decode(tokens: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``tokens`` with a column ``decoded``: the bytes of the array ``ids``; null ids give null.

    An id without a rank is an error of the library.  A column ``decoded`` is replaced.
    """
    shared = tokens.sparkSession.sparkContext.broadcast((ranks, pattern))

    @F.pandas_udf("binary")
    def joined(ids):
        encoder = _encoder(*shared.value)
        return ids.map(lambda x: None if x is None else encoder.decode(np.asarray(x)))

    return tokens.withColumn("decoded", joined("ids"))


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what ``encode`` gives; ids are joined
    by one space as decimal numbers."""
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, ranks, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
