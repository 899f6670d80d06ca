"""The whole pipeline on small tables: what it leaves behind, and awkward and empty input."""

import os

import pytest

import corpus_pipeline
from tests.llm.fixtures import awkward
from trajecta import session

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture()
def scratch(spark, tmp_path, monkeypatch):
    folder = tmp_path / "scratch"
    folder.mkdir()
    for module in (session, corpus_pipeline):
        monkeypatch.setattr(module, "scratch_dir", lambda _: str(folder))
    return folder


def _run(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    return corpus_pipeline.run(spark, str(tmp_path))


def test_only_the_last_result_is_left(spark, tmp_path, scratch):
    labels = [(1, 1, 0), (2, 1, 0), (8, 0, 1), (9, None, None), (None, 1, 1), (10, 0, 0)]
    out = _run(spark, tmp_path, awkward(spark), labels)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    rows = out.collect()
    assert rows and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert [n.split("-")[0] for n in os.listdir(scratch)] == ["bpe"]


def test_empty_tables_go_through(spark, tmp_path, scratch):
    assert _run(spark, tmp_path, awkward(spark, empty=True), []).collect() == []


def test_a_failing_stage_leaves_what_it_read(spark, tmp_path, scratch, monkeypatch):
    def broken(spark, docs, sf_dir):
        session.materialise(docs, "half")
        raise RuntimeError("lost")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:1], ("broken", broken)])
    with pytest.raises(RuntimeError, match="lost"):
        _run(spark, tmp_path, awkward(spark), [(1, 1, 0)])
    assert [n.split("-")[0] for n in os.listdir(scratch)] == ["toxicity"]


def test_stages_hand_on_few_rows_at_a_time(spark, tmp_path, scratch, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)

    def watched(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(name)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", watched), ("two", watched)])
    assert _run(spark, tmp_path, awkward(spark), []).count() == awkward(spark).count()
    assert seen == [corpus_pipeline.BATCH_ROWS] * 2 and spark.conf.get(name) == before
