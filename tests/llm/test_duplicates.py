"""SimHash groups, components, compact windows and repeated passages against brute force."""

import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.fixtures import LONG, awkward
from trajecta.llm import passages, simhash
from trajecta.llm.components import connected_components
from trajecta.llm.words import words


def roots(nodes, edges):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    w = words(text.encode() if text is not None else None)
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    codes = sorted(set(prints))
    near = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 2]
    root = roots(codes, near)
    low = defaultdict(list)
    for (d, _), p in zip(rows, prints):
        low[root[p]] += [d] if d is not None else []
    return [(d, f"{p:016x}", min(low[root[p]], default=None)) for (d, _), p in zip(rows, prints)]


def test_fingerprints_and_groups_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(docs, node_rows=3).collect()]
    assert sorted(got) == sorted(expected_groups(rows))


def test_near_duplicates_of_awkward_documents(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected_groups(rows), key=repr)
    assert simhash.near_duplicates(awkward(spark, True)).count() == 0


def test_spark_hashes_a_shingle_alike(spark):
    text = "häuser sind groß"
    ours = spark.sql(f"SELECT xxhash64('{text}') AS h").first().h
    assert ours % 2**64 == xxhash.xxh64_intdigest(text.encode(), seed=42)


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(9) == 1 and 1 in ids and 2 not in ids
    assert simhash.keep_one(awkward(spark, True)).count() == 0


@pytest.mark.parametrize("node_rows", [4, 50, 2048])
def test_links_join_what_is_near(spark, node_rows):
    rng = np.random.default_rng(node_rows)
    centres = rng.integers(0, 2**64, 6, dtype=np.uint64)
    codes = {int(c) for c in centres}
    for c in centres:  # a crowd around each centre
        for _ in range(90):
            x = int(c)
            for bit in rng.integers(0, 64, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            codes.add(x)
    codes = sorted(codes)
    df = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, node_rows).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in links)
    near = [(a, b) for i, a in enumerate(codes) for b in codes[i + 1 :] if (a ^ b).bit_count() <= 2]
    assert roots(codes, links) == roots(codes, near)


def test_index_finds_every_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, dtype=np.uint64)
    codes = np.unique(base ^ (np.uint64(1) << rng.integers(0, 64, (700, 3), dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
    i, j = simhash.GrayIndex(codes).pairs(2)
    want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if int(codes[a] ^ codes[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = connected_components(spark.createDataFrame([*edges, (5, 5), (None, 7)], "a long, b long"))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.node: r.component for r in got.collect()} == roots(nodes, edges)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def tree_windows(values, low, high, width, out):
    """The Cartesian tree from its definition."""
    if high - low < width:
        return
    c = min(range(low, high), key=lambda i: (values[i], i))
    out.append((low, c, high - 1))
    tree_windows(values, low, c, width, out)
    tree_windows(values, c + 1, high, width, out)


@pytest.mark.parametrize("seed", range(5))
def test_compact_windows_are_the_cartesian_tree(seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 40 if seed % 2 else 2**40, 500).astype(np.uint64) << np.uint64(21)
    walls = [90, 91, 300]
    values[walls] = 0
    want: list = []
    for low, high in zip([0, 91, 92, 301], [90, 91, 300, 500]):
        tree_windows(values.tolist(), low, high, 20, want)
    got = list(zip(*(x.tolist() for x in passages.compact_windows(values, 20))))
    assert sorted(got) == sorted(want)


def fifty_word_repeats(docs):
    """Places of all runs of fifty words that stand earlier as well, in the operator's order."""
    seen = defaultdict(list)
    for d, w in docs.items():
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].append((len(w), d, i))
    out = defaultdict(set)
    for places in seen.values():
        for _, d, i in sorted(places)[1:]:
            out[d].update(range(i, i + 50))
    return out


def test_all_exact_repeats_are_found_and_cut(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = {r.doc_id: words(r.text.encode()) for r in table.collect()}
    want = fifty_word_repeats(docs)
    assert want
    covered = defaultdict(set)
    for r in passages.repeated_passages(table).collect():
        assert r.end - r.start >= 50 and r.similarity >= 0.8
        a, b = docs[r.doc_id][r.start : r.end], docs[r.match_doc_id][r.match_start : r.match_end]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(x & y) / len(x | y) >= 0.75  # sets, where repeats inside a passage count once
        covered[r.doc_id].update(range(r.start, r.end))
    assert all(places <= covered[d] for d, places in want.items())
    left = {r.doc_id: words(r.text.encode()) for r in passages.without_repeats(table).collect()}
    for d, w in docs.items():
        if d not in covered:
            assert left[d] == w
    # What was cut from one place still stands somewhere, but for runs across a seam and the
    # single words in which a near copy differs.
    runs = {tuple(w[i : i + 5]) for w in left.values() for i in range(len(w) - 4)}
    cut = {tuple(docs[d][i : i + 5]) for d in want for i in want[d] if i + 5 <= len(docs[d])}
    assert len(cut - runs) <= 0.06 * len(cut)


def test_an_edited_passage_is_found(spark):
    base = [f"w{i}" for i in range(130)]
    edited = base[:60] + ["other"] + base[61:90] + base[91:]
    rows = [
        (1, " ".join([f"a{i}" for i in range(30)] + base)),
        (2, " ".join(edited + [f"b{i}" for i in range(60)])),
        (3, " ".join(f"c{i}" for i in range(200))),
        (4, " ".join(base[:45] + [f"d{i}" for i in range(200)])),
    ]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.end, r.match_doc_id, r.match_start, r.match_end) for r in found] == [(2, 0, 129, 1, 30, 160)]


def test_passages_of_awkward_documents(spark):
    docs = awkward(spark)
    found = passages.repeated_passages(docs).collect()
    assert {r.doc_id for r in found} <= {6, 7}
    assert any(r.doc_id == 7 and r.match_doc_id == 6 for r in found)
    cut = passages.without_repeats(docs)
    assert cut.columns == docs.columns
    left = {r.doc_id: r.text for r in cut.collect() if r.doc_id not in (None, 9, 10)}
    assert left[3] is None and left[4] == "" and left[1] == left[2]
    assert "and a tail" in left[7] and len(left[7]) < len(LONG)
    assert passages.repeated_passages(awkward(spark, True)).count() == 0
    assert passages.without_repeats(awkward(spark, True)).count() == 0


def test_cut_keeps_the_white_space_of_what_stays():
    assert passages.cut(b"  a b\n\nc  d e ", [{"start": 1, "end": 3}]) == "  a d e "
    assert passages.cut(b"a b", [{"start": 0, "end": 2}]) is None
    assert passages.cut(None, None) is None


def test_hot_key_links_once_per_member(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string")
    found = passages.repeated_passages(docs)
    assert found.count() == 299 and found.filter("match_doc_id >= doc_id").count() == 0
    groups = simhash.near_duplicates(docs)
    assert groups.select("component_id").distinct().collect() == [(0,)]
    assert groups.agg(F.count("*")).first()[0] == 300


def fresh(tag, n):
    return [f"{tag}{i}" for i in range(n)]


def test_short_passages_with_a_changed_word_are_found(spark):
    rows, want = [], {}
    for k in range(60):
        size = (50, 54, 60)[k % 3]
        base = fresh(f"p{k}-", size)
        at = (size // 2, 20, 15, size // 2 - 1)[k % 4]
        edited = base[:at] + [f"new{k}"] + base[at + 1 :]
        rows.append((2 * k, " ".join(fresh(f"a{k}-", 40 + k) + base + fresh(f"b{k}-", 50))))
        rows.append((2 * k + 1, " ".join(fresh(f"c{k}-", 80) + edited + fresh(f"d{k}-", 60 + k))))
        want[2 * k + 1] = (80, 80 + size, 2 * k, 40 + k, 40 + k + size)
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.start, r.end, r.match_doc_id, r.match_start, r.match_end) for r in found} == want
    assert len(found) == len(want) and all(r.similarity >= 0.8 for r in found)


def test_shorter_quotes_do_not_hide_a_repeat(spark):
    rows, want = [], {}
    for k in range(40):
        base = fresh(f"p{k}-", 50 + k % 2 * 10)
        rows.append((10 * k, " ".join(base[: 45 + k % 5] + fresh(f"q{k}-", 10))))
        rows.append((10 * k + 1, " ".join(fresh(f"r{k}-", 10) + base[-(45 + k % 5) :])))
        rows.append((10 * k + 2, " ".join(fresh(f"x{k}-", 40) + base + fresh(f"s{k}-", 30))))
        rows.append((10 * k + 3, " ".join(fresh(f"y{k}-", 70) + base + fresh(f"t{k}-", 20))))
        want[10 * k + 3] = (70, 70 + len(base), 10 * k + 2)
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        found = passages.repeated_passages(docs).collect()
        assert {r.doc_id: (r.start, r.end, r.match_doc_id) for r in found} == want and len(found) == len(want)


def put_in(k):
    """Two runs under fifty words, with words put in between."""
    a, b, new = fresh(f"p{k}-", 45), fresh(f"q{k}-", 45 + k % 4), fresh(f"new{k}-", 8 + k % 4)
    return [fresh(f"a{k}-", 40) + a + b + fresh(f"b{k}-", 50), fresh(f"c{k}-", 80) + a + new + b + fresh(f"d{k}-", 90)], a + new + b


def beyond(k):
    """The first place differs and then agrees for five words; the second one agrees all along."""
    x, more = fresh(f"x{k}-", 55 + k % 10), fresh(f"t{k}-", 15 + k % 6)
    first = x + fresh(f"r{k}-", 7) + more[7:12] + fresh(f"s{k}-", 20)
    return [first, fresh(f"u{k}-", 60) + x + more + fresh(f"v{k}-", 40), fresh(f"w{k}-", 90) + x + more + fresh(f"z{k}-", 80)], x + more


def overlapping(k):
    """Two earlier texts hold a part each, and both the words in the middle."""
    x = fresh(f"x{k}-", 85 + k % 15)
    first, second = fresh(f"a{k}-", 10) + x[:75] + fresh(f"b{k}-", 30), fresh(f"c{k}-", 50) + x[25 - k % 10 :] + fresh(f"d{k}-", 80)
    return [first, second, fresh(f"e{k}-", 120) + x + fresh(f"f{k}-", 120)], x


@pytest.mark.parametrize("case", [put_in, beyond, overlapping])
def test_all_words_of_passages_are_held(spark, case):
    rows, want = [], {}
    for k in range(30):
        texts, passage = case(k)
        rows += [(10 * k + i, " ".join(t)) for i, t in enumerate(texts)]
        at = texts[-1].index(passage[0])
        want[10 * k + len(texts) - 1] = set(range(at, at + len(passage)))
    covered = defaultdict(set)
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered[r.doc_id].update(range(r.start, r.end))
    assert all(places <= covered[d] for d, places in want.items())


@pytest.mark.parametrize("edit", ["replaced", "inserted", "apart"])
def test_larger_differences_are_verified(edit):
    a = np.random.default_rng(3).integers(1, 2**63, 96).astype(np.uint64)
    new = np.arange(1, 5, dtype=np.uint64)
    b = {"replaced": np.r_[a[:46], new, a[50:]], "inserted": np.r_[a[:48], new[:3], a[48:]], "apart": a.copy()}[edit]
    if edit == "apart":
        b[[46, 49]] = new[:2]
    for anchor in ((10, 10), (80, 80 + len(b) - len(a))):
        (found,) = passages.verified(a, b, [anchor])
        assert found[:4] == (0, 96, 0, len(b)) and found[4] >= 0.8


def test_many_surroundings_of_a_passage_are_all_found(spark):
    base = fresh("p", 60)
    rows = [(k, " ".join(fresh(f"a{k}-", 60 + k) + base[: 50 + k % 11] + fresh(f"b{k}-", 90))) for k in range(40)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = defaultdict(set)
    for r in found:
        covered[r.doc_id].update(range(r.start, r.end))
    longest = np.maximum.accumulate([0] + [50 + k % 11 for k in range(40)])
    assert {k: len(v) for k, v in covered.items()} == {k: min(50 + k % 11, int(longest[k])) for k in range(1, 40)}


def test_a_text_under_a_shared_id_stays_in_its_own_group(spark):
    a, b = " ".join(fresh("a", 40)), " ".join(fresh("b", 40))
    for swap in (False, True):  # whichever hash comes first
        x, y = (b, a) if swap else (a, b)
        rows = [(3, x), (5, x), (5, y), (None, x), (None, x), (None, x)]
        kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(map(tuple, kept), key=repr) == sorted([(3, x), (5, y), (None, x)], key=repr)


def test_order_is_that_of_all_columns():
    rng = np.random.default_rng(5)
    columns = tuple(rng.integers(0, k, 3000) for k in (900, 3, 2, 2, 4, 50, 9))
    columns[0][:40] = -7
    found = passages._order(columns)
    ordered = np.stack([c[found] for c in columns])
    assert (ordered == np.stack([c[np.lexsort(columns[::-1])] for c in columns])).all()


def test_places_of_a_common_key_take_little_memory():
    """Places that nearly agree are compared by their shingles, which no place keeps."""
    rng = np.random.default_rng(6)
    size, count = passages._CONTEXT, 1500
    words = np.tile(rng.integers(1, 1 << 16, size, dtype=np.uint16), (count, 1))
    words[np.arange(count), 20 + np.arange(count) % 18] = rng.integers(1, 1 << 16, count)
    words[np.arange(count), 64 + np.arange(count) % 17] = rng.integers(1, 1 << 16, count)
    columns = [np.zeros(count, np.int64), np.full(count, 400), np.arange(count), np.zeros(count, np.int64), np.full(count, 90)]
    batch = pa.RecordBatch.from_arrays(
        [*map(pa.array, columns), pa.array([w.tobytes() for w in words])], names=["key", "n", "doc", "ver", "at", "words"]
    )
    tracemalloc.start()
    found = sum(links.num_rows for links in passages._compare(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found >= count - 1 and peak / count < 9_000
