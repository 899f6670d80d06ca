"""Classifiers and the language network: held-out accuracy, gradients, awkward input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward
from trajecta.llm import language, learning, quality, toxicity

MIDDLE = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet"), spark.read.parquet(f"{MIDDLE}/labels.parquet")


def accuracy(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    assert len(rows) > 30
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_toxicity_on_held_out_documents(tables):
    docs, labels = tables
    scored = toxicity.toxicity(docs, labels)
    assert accuracy(scored, labels, "toxic") > 0.9
    assert scored.count() == docs.count()
    assert scored.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0


def test_quality_on_held_out_documents(tables):
    docs, labels = tables
    scored = quality.quality(docs, labels)
    assert accuracy(scored, labels, "quality") > 0.93
    assert scored.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0


def test_language_on_held_out_documents(tables):
    docs, _ = tables
    found = language.identify(docs).filter("held_out").join(docs, "doc_id").select("lang_pred", "lang").collect()
    assert sum(a == b for a, b in found) / len(found) > 0.97


def test_labels_and_language_are_no_inputs(tables):
    docs, labels = tables
    changed = docs.withColumn("source", F.lit("x")).withColumn(
        "lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang"))
    )
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.toxicity(docs, labels).orderBy("doc_id", "score").collect()
    assert a == toxicity.toxicity(changed, flipped).orderBy("doc_id", "score").collect()
    a = language.identify(docs).orderBy("doc_id", "score").collect()
    assert a == language.identify(changed).orderBy("doc_id", "score").collect()


@pytest.mark.parametrize("make", [toxicity.toxicity, quality.quality])
def test_classifiers_take_awkward_documents(spark, make):
    rows = [(1, 1, 0), (1, 0, 1), (2, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (10, 5, 5), (99, 1, 1)]
    docs = awkward(spark)
    for labels in (rows, [], [(1, 1, 1)]):
        out = make(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(out) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in out)
        by = {r.doc_id: r.score for r in out}
        assert by[1] == by[2] and by[3] == by[4]
        assert make(awkward(spark, True), spark.createDataFrame(labels, LABELS)).count() == 0


def test_toxic_rows_go_with_their_columns(spark):
    words = ["vile", "calm"]
    docs = spark.createDataFrame(
        [(i, f"some {words[i % 2]} text number {i % 7}", "s") for i in range(400)], "doc_id long, text string, score string"
    )
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(0, 400)], LABELS)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(1, 400, 2))


def test_ftrl_weights_are_sparse():
    rng = np.random.default_rng(0)
    examples = [(np.unique(np.append(rng.integers(100, 5000, 40), 7 if y else 8)).astype(np.int32), y) for y in rng.integers(0, 2, 600).tolist()]
    w = toxicity.ftrl(examples)
    dense = w.dense()
    assert dense[7] > 0 > dense[8] and len(w.buckets) < 50


def test_language_of_awkward_documents(spark):
    docs = awkward(spark)
    out = language.identify(docs).collect()
    assert len(out) == docs.count()
    by = {r.doc_id: r for r in out}
    for d in (3, 4, 5, 8):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in out)
    assert by[6].lang_pred in {"en", "de", "fr", "es"}
    assert language.identify(awkward(spark, True)).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    params = [rng.normal(0, 0.3, (257, 9)) for _ in range(2)] + [rng.normal(0, 0.3, (3, 9)) for _ in range(2)]
    params += [rng.normal(0, 0.3, (6, 2)), np.zeros(2)]
    x, y = language.segments(b"abcabdaabbcadd" * 20), np.array([0, 1, 1])
    _, grads = language.loss_and_gradients(params, x, y)
    for k, at in ((0, (98, 4)), (1, (99, 0)), (2, (1, 7)), (3, (2, 1)), (4, (1, 0)), (5, (1,))):
        ends = []
        for step in (1e-3, -1e-3):
            moved = [p.copy() for p in params]
            moved[k][at] += step
            ends.append(language.loss_and_gradients(moved, x, y)[0])
        assert grads[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-3, rel=2e-2, abs=2e-6)


def test_pairs_rank_by_preference():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = (x[:, 1] + 0.1 * rng.normal(size=500) > -0.8).astype(int)
    model = quality.rank(x, y, float((1 - y).mean()))
    assert ((model.score(x) >= quality.CUT) == y).mean() > 0.93
    assert quality.rank(x, np.ones(500, int), 0.0) is None


def test_pair_weights_minimise_the_loss():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0.5, 1, (400, 3)), rng.normal(0, 1, (400, 3))

    def loss(w):
        return np.log1p(np.exp(-(good - bad) @ w)).mean() + 0.005 * w @ w

    w = quality.bradley_terry(good, bad, ridge=0.01)
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=3)) for _ in range(50))


def test_quality_is_cut_at_the_quantile_of_all_documents(spark, tables):
    docs, labels = tables
    bad = labels.filter("quality = 0").select("doc_id")
    # Three unlabelled copies of every bad document, so the labelled rows differ from the table.
    copies = docs.join(bad, "doc_id").select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10**9)
    docs = docs.unionByName(copies).unionByName(copies).unionByName(copies)
    known = labels.filter("quality IN (0, 1)").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    share = known.agg(F.avg(1 - F.col("quality"))).first()[0]
    out = [r.score for r in quality.quality(docs, labels).collect()]
    assert sum(s < 0.3 - 1e-9 for s in out) <= share * len(out) + 1
    assert sum(s <= 0.3 + 1e-9 for s in out) >= share * len(out) - 1


def test_toxic_documents_are_recalled_from_few_labels(tables):
    docs, labels = tables
    known = toxicity.toxicity(docs, labels).join(labels.filter("toxic IN (0, 1)").select("doc_id", "toxic"), "doc_id")
    rows = known.select("predicted", "toxic").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_a_doc_id_in_many_rows_is_one_document_of_a_sample(spark, monkeypatch):
    """One id holds nearly all rows, alike and not: each sample takes one text of it."""
    hot = [(7, f"the same id {k % 9} with a text of its own", "en") for k in range(2000)]
    rows = [*hot, *[(k, f"der text nummer {k}", "de") for k in range(10, 20)], *[(k, f"the text {k}", "en") for k in range(20, 30)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in {r[0] for r in rows}], "doc_id long, quality int, toxic int")
    sample = learning.labelled_sample(docs, labels, "toxic", 5, 0, 50).collect()
    assert len(sample) == len({r.doc_id for r in sample})
    assert [r.text for r in sample if r.doc_id == 7] in ([], [r.text for r in learning.labelled_sample(
        docs.repartition(7), labels, "toxic", 5, 0, 50).collect() if r.doc_id == 7])
    seen = []
    monkeypatch.setattr(language, "train", lambda x, y, languages: seen.append((x, y, languages)))
    language.fit(docs, 50)
    (x, y, languages), = seen
    assert languages == ["de", "en"] and len(x) < 50
