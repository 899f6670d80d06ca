"""Byte-level BPE against the tiktoken library on whole texts."""

import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import awkward, ordered
from trajecta.llm import byte_bpe
from trajecta.llm.queries import op12_byte_bpe, ranks

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def expected(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    digest = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (text or "").encode())]
    return (doc_id, len(ids), *digest)


def test_all_documents_match_the_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = [tuple(r) for r in op12_byte_bpe(spark, sf_dir).collect()]
    assert ordered(found) == ordered(expected(library, *r) for r in rows)


def test_awkward_documents(spark, library):
    docs = awkward(spark)
    found = [tuple(r) for r in byte_bpe.digests(docs, ranks(), PATTERN).collect()]
    assert ordered(found) == ordered(expected(library, r.doc_id, r.text) for r in docs.collect())
    assert byte_bpe.digests(awkward(spark, empty=True), ranks(), PATTERN).collect() == []


def test_decoding_gives_the_bytes_of_the_text(spark):
    docs = awkward(spark).select("doc_id", "text")
    back = byte_bpe.decode(byte_bpe.encode(docs, ranks(), PATTERN).drop("decoded"), ranks(), PATTERN)
    texts = ordered((r.doc_id, (r.text or "").encode()) for r in docs.collect())
    assert ordered((r.doc_id, bytes(r.decoded)) for r in back.collect()) == texts


ALPHABET = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　ab'sdtrevlm019.,!ñß漢٣😀́"


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=60), st.integers(1, 7))
def test_cut_texts_have_the_tokens_of_whole_ones(library, text, size):
    cut = list(byte_bpe.parts(text, size))
    assert "".join(cut) == text
    assert [i for part in cut for i in library.encode_ordinary(part)] == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["word " * 200_000, "x" * 400_000, " " * 400_000, " \n" * 150_000 + "end", "a1!" * 100_000])
def test_very_long_texts(library, text):
    encoder = byte_bpe.Encoder(ranks(), PATTERN)
    ids = encoder.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()
