"""Tokenization, mixing, rollups, search, neighbours and the pipeline."""

import gc
import hashlib
import math
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.compare import compare, oracle_connection
from tests.llm.fixtures import awkward
from trajecta.llm import bpe, mixing, neighbours, rollups, search
from trajecta.llm.queries import ORACLES, QUERIES, vocabulary
from trajecta.llm.words import plain_words


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def agrees(encoder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = encoder.encode(text)
    return np.frombuffer(ids, "<u4").tolist() == want and encoder.decode(ids).decode() == library.decode(
        want, skip_special_tokens=False
    )


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeinorst' 1!é\n\x1c　ΣİÅ"), st.characters(max_codepoint=0x2FFF)), max_size=60))
def test_encoding_agrees_with_the_library(encoder, library, text):
    assert agrees(encoder, library, text) or any(_newer(c) for c in text)


def test_marks_newer_than_the_library_stay_in_place(encoder, library):
    new = ["\u07fd", "\u0898", "\u0d3b", "\u1715", "\u1abf", "\u1ace", "\u1df6", "\ua82c", "\U0001193d", "\U0001e4ef"]
    for mark in new:
        for other in ("\u1bf2", "\u0316", "\u0301", "\u0345"):
            assert agrees(encoder, library, f"a{mark}{other}e{other}{mark}{other}")
    assert agrees(encoder, library, "\U00011935\U00011930")


def test_a_task_leaves_no_encoder_in_its_worker():
    def encoders():
        gc.collect()
        return sum(isinstance(x, bpe.Encoder) for x in gc.get_objects())

    before = encoders()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["two words", None]})
    (out,) = bpe._encode_batches(iter([batch]), vocabulary())
    assert out.column("decoded").to_pylist() == ["two</w> words</w>", ""] and encoders() == before


def test_labels_that_no_other_continues_need_no_node_of_the_tree():
    vocab = {text: i for i, text in enumerate(("a", "b", "c</w>", "ab", "abc</w>"))}
    automaton = bpe.Automaton(vocab, [("a", "b"), ("ab", "c</w>")], "</w>")
    assert automaton.trie == {"a": {"": 0, "b": {"": 3, "c": {bpe._END: 4}}}, "b": 1, "c": {bpe._END: 2}}
    assert automaton.encode("abc" + bpe._END) == [4] and automaton.encode("bab") == [1, 3]


def test_words_and_marks_below_the_supplement_are_found_by_smaller_classes():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]):
        text = f"a{c}{c}'s{c}1'"
        assert bpe._LOW_WORDS.findall(text) == bpe._WORDS.findall(text)
        assert bool(bpe._LOW_NEWER.search(c)) == bool(bpe._NEWER.search(c))
    assert len(bpe._LOW_WORDS.pattern) < 0.7 * len(bpe._WORDS.pattern)


def test_words_above_the_supplement_agree_with_the_library(encoder, library):
    for text in ("a\U00010400b", "\U0001d7ce1", "it's\U0001f600's", "\U00011935\U00011930x", "'S 'll'x \U00020000\u1abf\u1bf2"):
        assert agrees(encoder, library, text)
    assert agrees(encoder, library, "\u1bf2\u1abf")


def test_a_word_that_also_stands_alone_is_kept_once():
    encoder = bpe.Encoder(vocabulary())
    encoder.encode("word word, word")
    kept = [key for cache in vars(encoder).values() if isinstance(cache, bpe._Kept) for key in cache]
    assert sorted(kept) == [",", "word", "word,"]


def _newer(c):
    """Unassigned in this Python's Unicode, where the library may know more."""
    import unicodedata

    return unicodedata.category(c) == "Cn" or c in "Ᲊᲊ"


@pytest.mark.parametrize(
    "text", ["<|endoftext|>it's", "A<|startoftext|> B<|endoftext|>", "<|ENDOFTEXT|>", "é<|endoftext|>́", "Σας", "a" * 3000, "!" * 999, ""]
)
def test_special_texts_agree_with_the_library(encoder, library, text):
    assert agrees(encoder, library, text)


def merged(symbols, merges):
    """The merges one after another, which is what the automaton must accept."""
    symbols = list(symbols)
    for a, b in merges:
        out, i = [], 0
        while i < len(symbols):
            if symbols[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeinorsth", min_size=1, max_size=25))
def test_automaton_accepts_what_the_merges_give(text):
    import json

    model = json.loads(vocabulary())["model"]
    merges = [tuple(m) for m in model["merges"] if "</w>" not in m[1]][:600]
    base = sorted({c for m in merges for x in m for c in x} | set("aeinorsth"))
    vocab = {t: i for i, t in enumerate([*base, *(a + b for a, b in merges)])}
    machine = bpe.Automaton(vocab, merges)
    names = {i: t for t, i in vocab.items()}
    assert [names[i] for i in machine.encode(text)] == merged(text, merges)


def test_encoding_awkward_documents(spark, encoder, library):
    docs = awkward(spark)
    out = bpe.digests(docs, vocabulary()).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        packed = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    assert bpe.digests(awkward(spark, True), vocabulary()).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, oracle_connection(sf_dir), QUERIES[name], ORACLES[name], sf_dir) == ""


def highest_quotients(targets, seats):
    won = Counter()
    for _ in range(seats):
        best = max(range(len(targets)), key=lambda i: (targets[i][1] / (2 * won[i] + 1), -i))
        won[best] += 1
    return [won[i] for i in range(len(targets))]


def test_shard_quotas_are_sainte_lague(spark):
    sizes = [("a", 900), ("b", 40), ("c", 3000), ("d", 0), ("e", 900), (None, 77)]
    planned = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"))
    targets = sorted([(r.source, r.target) for r in planned.collect()], key=lambda x: (x[0] is None, x[0] or ""))
    total = sum(s for _, s in sizes)
    assert sum(t for _, t in targets) == pytest.approx(total)
    by = dict(sizes)
    assert all(t <= 3 * by[s] + 1e-9 for s, t in targets)
    got = {(r.source, r.shard): r for r in mixing.quotas(planned, 8, 5).collect()}
    for shard in range(1, 6):
        want = highest_quotients([t for t in targets if t[1] > 0], total // 8 * shard // 5)
        names = [s for s, t in targets if t > 0]
        assert [got[s, shard].upto for s in names] == want
    assert sum(r.quota for r in got.values()) == total // 8


def test_shard_blocks_are_the_quotas(spark):
    sized = spark.createDataFrame([(i, "ab"[i % 3 == 0], 10 + i % 50, i) for i in range(200)], "doc_id long, source string, size long, tie long")
    blocks = [tuple(r) for r in mixing.shard_blocks(sized, 16, 4).collect()]
    assert len(blocks) == len(set(b[1:] for b in blocks)) == sized.agg(F.sum("size")).first()[0] // 16


def test_mixed_documents_hold_the_words_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(r.text.encode().split())
    assert {d: n for d, n in taken.items() if n} == dict(got)


def test_mixing_awkward_documents(spark):
    docs = awkward(spark)
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    assert sorted(out, key=repr) == sorted(mixing.mix(docs.repartition(5)).collect(), key=repr)
    assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in out)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.encode().split()) for r in mixed.collect()) == sum(r.taken for r in out)
    assert mixing.mix(awkward(spark, True)).count() == 0
    assert mixing.mixed_documents(awkward(spark, True)).count() == 0
    silent = docs.filter("doc_id IN (3, 4, 5)")
    assert {(r.target, r.taken) for r in mixing.mix(silent).collect()} == {(0.0, 0)}


def test_rollup_batches_are_additive_and_idempotent(spark, tmp_path):
    docs = awkward(spark)
    counts = rollups.count_tokens(docs, {"v1": r"\S+"})
    store = rollups.Rollup(spark, str(tmp_path / "totals"))
    assert store.totals().count() == 0
    assert store.commit("one", rollups.signed(counts, 1))
    first = sorted(store.totals().collect(), key=repr)
    assert not store.commit("one", rollups.signed(counts, 1))
    assert sorted(store.totals().collect(), key=repr) == first
    want = {}
    for r in docs.collect():
        n, t = want.get((r.source, r.lang), (0, 0))
        want[r.source, r.lang] = (n + 1, t + len((r.text or "").split()))
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in first} == want
    gone = counts.filter("doc_id = 6")
    (tmp_path / "totals" / "batch=two").mkdir()
    (tmp_path / "totals" / "batch=two" / "part-left.parquet").write_bytes(b"left by a failed attempt")
    assert sorted(store.totals().collect(), key=repr) == first
    assert store.commit("two", rollups.signed(gone, -1))
    assert store.commit("three", rollups.revised(counts.filter("doc_id = 1"), counts.filter("doc_id = 1").withColumn("lang", F.lit("fr"))))
    assert store.commit("none", rollups.signed(counts.filter("doc_id = -1"), 1))
    after = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert ("a", "de") not in after and after["a", "fr"] == (1, 6)
    with pytest.raises(ValueError):
        store.commit("../up", rollups.signed(counts, 1))


def bm25(docs, queries, k):
    n, df = len(docs), Counter(t for c in docs.values() for t in c)
    length = {d: sum(c.values()) for d, c in docs.items()}
    mean = sum(length.values()) / n
    out = {}
    for q in queries:
        found = []
        for d, c in docs.items():
            shared = [t for t in docs[q] if t in c]
            if d != q and shared:
                s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length[d] / mean)) for t in shared)
                found.append((-round(s, 9), d))
        out[q] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("shard_words,block", [(4_000_000, 8192), (6_000, 2)])
def test_search_is_exact(spark, sf_dir, shard_words, block):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: Counter(plain_words(r.text.encode())) for r in table.collect()}
    got = {}
    for r in search.top_k(table, F.col("doc_id") % 20 == 0, 7, shard_words, block).collect():
        got.setdefault(r.query_id, {})[r.rank] = (-round(r.score, 9), r.doc_id)
    want = bm25(docs, [d for d in docs if d % 20 == 0], 7)
    for q, rows in want.items():
        assert [d for _, d in rows] == [got[q][i + 1][1] for i in range(len(rows))]
        assert [s for s, _ in rows] == pytest.approx([got[q][i + 1][0] for i in range(len(rows))])


def test_search_of_awkward_documents(spark):
    docs = awkward(spark)
    rows = search.top_k(docs, F.lit(True)).collect()
    best = {(r.query_id, r.rank): r.doc_id for r in rows}
    assert best[1, 1] == 2 and best[2, 1] == 1 and best[6, 1] == 7
    assert not {3, 4, 5, 11} & {r.query_id for r in rows}
    assert all(r.query_id != r.doc_id and r.score > 0 for r in rows)
    assert len({(r.query_id, r.doc_id) for r in rows}) == len(rows)
    assert search.top_k(awkward(spark, True), F.lit(True)).count() == 0


def shuffled_bytes(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = (blocks.apply(i) for i in range(blocks.size()))
    return sum(f.length() for f in files if f.getName().startswith("shuffle_"))


def test_texts_are_not_copied_for_each_block_of_queries(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = table.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled_bytes(spark)
    found = search.top_k(table, F.col("doc_id") % 5 == 0, 7, 6_000, 2)
    assert found.count() > 0
    for _ in range(50):  # they are deleted beside other work
        left = shuffled_bytes(spark) - before
        if left < size / 2:
            break
        time.sleep(0.1)
    assert left < size / 2


def test_numbers_are_packed_in_the_least_type():
    for values in ([], [0, 255], [0, 256], [-1, 70_000], [2**40]):
        array = np.array(values, np.int64)
        back = search._unpacked(pa.scalar(search._packed(array), pa.binary()))
        assert back.tolist() == values and back.itemsize <= array.itemsize
    hashes = np.array([1, 2**64 - 1], np.uint64)
    assert search._unpacked(pa.scalar(search._packed(hashes), pa.binary())).dtype == np.uint64


def exact_neighbours(vectors, queries, k):
    out = {}
    for q in queries:
        scores = sorted((-float(np.dot(v, vectors[q])), i) for i, v in vectors.items() if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=12).round(3) * rng.uniform(0.5, 2) for i in range(900)}
    vectors |= {i: np.full(12, 0.25) for i in range(900, 1000)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    want = exact_neighbours(vectors, range(0, 1000, 20), 20)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=300, query_rows=20).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert r.score == pytest.approx(float(np.dot(vectors[r.query_id], vectors[r.vec_id])))
    hits = sum(len(set(want[q]) & set(got[q].values())) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    assert [got[900][i] for i in range(1, 21)] == want[900] or vectors[900] @ vectors[want[900][0]] > 0.75


def test_neighbours_on_the_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table.collect()}
    want = exact_neighbours(vectors, [i for i in vectors if i % 20 == 0], 20)
    hits = sum(r.vec_id in want[r.query_id] for r in QUERIES["op1_neighbours"](spark, sf_dir).collect())
    assert hits / sum(map(len, want.values())) >= 0.9


def test_neighbours_of_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
        (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [-1.0, 0.0]), (10, [2.0, 0.0]),
    ]
    schema = "vec_id long, embedding array<double>, rank string, query_id string, score string"
    df = spark.createDataFrame([(*r, "r", "q", "s") for r in rows], schema)
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()]
    assert got == [
        (0, 1, 9, 1.0), (0, 2, 1, 0.5), (0, 3, 10, -1.0),
        (10, 1, 1, -0.5), (10, 2, 0, -1.0), (10, 3, 9, -1.0),
    ]
    assert neighbours.nearest(df.filter("vec_id IS NULL"), F.lit(True)).count() == 0


def test_chi_square_law():
    # From tables of the distribution with six degrees of freedom.
    assert neighbours.chi_square(np.array([0.0, 5.348, 12.592, 16.812]), 6) == pytest.approx([0, 0.5, 0.95, 0.99], abs=1e-4)


def test_pipeline_stages_take_awkward_documents(spark, tmp_path):
    awkward(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_pipeline_rejects_toxic_documents_and_is_the_same_again(spark):
    sf_dir = "/root/testdata/sf0.01"
    ids = [r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").collect()}
    # Few toxic labels to learn from here: about a quarter is missed (none of 164 on a larger set).
    assert ids and len(set(ids) & toxic) <= 0.3 * len(toxic)
    again = [r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(ids) == sorted(again)
