"""Snapshots of the table store: a stage's tables change together or not at all."""

import pytest
from pyspark.sql import functions as F

from trajecta.sources.store import ConflictError, TableStore


@pytest.fixture()
def store(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    assert store.write(_tables(spark, 1)) == {"a": 3, "b": 3}
    return store


def _tables(spark, run, names=("a", "b")):
    return {n: spark.range(3).select((F.col("id") + 10 * run).alias("id"), F.lit(run).alias("run")) for n in names}


def _runs(store):
    return {n: {r["run"] for r in store.read(n).collect()} for n in ("a", "b")}


def _folders(tmp_path, table):
    return sorted(p.name for p in (tmp_path / "store" / table).iterdir())


def test_readers_see_all_tables_of_a_run_or_none(spark, store):
    old = store.read("a")
    with store.stage(_tables(spark, 2)) as staged:
        assert _runs(store) == {"a": {1}, "b": {1}}
        assert staged.read("a").count() == 3
        assert staged.publish() == {"a": 3, "b": 3}
    assert _runs(store) == {"a": {2}, "b": {2}}
    # A reader that began before stays with its snapshot, and it can be read again by number.
    assert {r["run"] for r in old.collect()} == {1}
    assert store.versions() == [1, 2]
    assert {r["run"] for r in store.read("b", version=1).collect()} == {1}


def test_a_run_killed_between_two_tables_leaves_the_old_set(spark, store, tmp_path):
    tables = _tables(spark, 2)
    tables["b"] = tables["b"].withColumn("run", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        store.write(tables)
    assert _runs(store) == {"a": {1}, "b": {1}} and store.versions() == [1]
    assert len(_folders(tmp_path, "a")) == len(_folders(tmp_path, "b")) == 1


def test_what_a_killed_run_leaves_is_never_read_and_can_be_deleted(spark, store, tmp_path, monkeypatch):
    staged = store.stage(_tables(spark, 2))  # killed here: neither published nor dropped
    monkeypatch.setattr(staged.store.commits, "create", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        staged.publish()
    fresh = TableStore(spark, store.root)
    assert _runs(fresh) == {"a": {1}, "b": {1}}
    assert len(_folders(tmp_path, "a")) == 2
    assert sorted(fresh.vacuum()) == sorted(staged.folders.values())
    assert _runs(fresh) == {"a": {1}, "b": {1}} and len(_folders(tmp_path, "a")) == 1


def test_vacuum_keeps_the_last_snapshots(spark, store, tmp_path):
    for run in (2, 3, 4):
        store.write(_tables(spark, run, ("a",)))
    assert store.snapshot()["a"]["since"] == 4 and store.snapshot()["b"]["since"] == 1
    store.vacuum(keep=2)
    assert store.versions() == [3, 4]
    assert len(_folders(tmp_path, "a")) == 2 and len(_folders(tmp_path, "b")) == 1
    assert _runs(store) == {"a": {4}, "b": {1}}


def test_two_runs_of_different_tables_both_count(spark, store):
    with store.stage(_tables(spark, 2, ("a",))) as first, store.stage(_tables(spark, 3, ("b",))) as second:
        second.publish()
        first.publish()
    assert _runs(store) == {"a": {2}, "b": {3}}


def test_two_runs_of_one_table_conflict(spark, store, tmp_path):
    with pytest.raises(ConflictError, match="another run: a"):
        with store.stage(_tables(spark, 2, ("a",))) as first, store.stage(_tables(spark, 3, ("a",))) as second:
            second.publish()
            first.publish()
    assert _runs(store) == {"a": {3}, "b": {1}}
    assert len(_folders(tmp_path, "a")) == 2


def test_a_table_without_a_snapshot_is_a_plain_folder(spark, store):
    spark.range(5).write.parquet(f"{store.root}/plain")
    assert store.read("plain").count() == 5
    store.vacuum()
    assert store.read("plain").count() == 5
    with pytest.raises(FileNotFoundError, match="run the national stage first"):
        store.read("d_prenom")
