"""All stages on a synthetic register: contract of the tables, gates and planted faults."""

import json

import pytest
from pyspark.sql import functions as F

from tests import register as synthetic
from trajecta.config import Settings
from trajecta.operators import quality
from trajecta.plans import stages
from trajecta.schemas import TABLES, from_contract
from trajecta.sources.provenance import manifest_document
from trajecta.sources.register import read_register
from trajecta.sources.store import TableStore

SETTINGS = Settings(restarts=4, draws=2)


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("register")
    paths = {k: str(root / k) for k in ("register", "codes", "out")}
    synthetic.register(spark).write.parquet(paths["register"])
    synthetic.write_codes(spark, paths["codes"])
    return paths


@pytest.fixture(scope="module")
def rows(spark, paths):
    return stages.run(spark, paths["register"], paths["codes"], paths["out"], SETTINGS)


@pytest.fixture(scope="module")
def store(spark, paths, rows):
    return TableStore(spark, paths["out"])


@pytest.fixture(scope="module")
def source(spark, paths):
    return read_register(spark, paths["register"])


def test_twelve_tables_with_their_contract(store, rows):
    assert set(rows) == set(TABLES)
    for name, columns in TABLES.items():
        df = store.read(name)
        assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [c[1:] for c in columns]
        assert df.count() == rows[name] > 0


def test_every_check_passes(store, source):
    report = stages.verify(store, source, SETTINGS).collect()
    assert len(report) > 50
    assert [r["check"] for r in report if not r["passed"]] == []


def test_names_of_both_sexes_keep_two_rows(store):
    dim = store.read("d_prenom").filter("prenom = 'ANDRÉA'").orderBy("sexe_code").collect()
    assert [r["libelle_segment"] for r in dim] == ["Andréa (M)", "Andréa (F)"]
    assert {r["prenom_recherche"] for r in dim} == {"andrea"}


def test_keys_follow_the_order_of_names(store):
    dim = [(r["prenom"], r["sexe_code"]) for r in store.read("d_prenom").orderBy("prenom_id").collect()]
    assert dim == sorted(dim)
    ids = store.read("d_prenom").agg(F.min("prenom_id"), F.max("prenom_id")).first()
    assert tuple(ids) == (1, len(dim))


def test_a_rare_name_is_unclassified(store):
    rare = store.read("d_prenom").filter("prenom = 'RARISSIME'").select("prenom_id")
    row = store.read("prenom_archetype").join(rare, "prenom_id").first()
    assert (row["archetype_id"], row["distance_centre"]) == (0, None)
    assert store.read("traits").join(rare, "prenom_id").count() == 0


def test_reports(store):
    trajectory = stages.trajectory_report(store, SETTINGS)
    assert trajectory["coverage"].first()["pct"] > 99
    assert trajectory["distribution"].count() == 5
    assert {r["segment"] for r in trajectory["witnesses"].collect()} == {"Camille (M)", "Camille (F)"}
    groups = stages.archetype_report(store, SETTINGS)
    assert 0 < groups["silhouette"].first()[0] <= 1
    assert -1 <= groups["stability"].first()["stability"] <= 1
    assert groups["composition"].count() == 5
    assert groups["representatives"].count() == 5
    assert [r["archetype"] for r in groups["composition"].collect()] == [1, 2, 3, 4, 5]
    geography = stages.geography_report(store)
    assert geography["coverage"].first()["entities"] > 10
    top = [r["index"] for r in geography["specificities"].collect()]
    assert len(top) == 12 and top == sorted(top, reverse=True)


def test_the_assignment_is_a_relation_for_sql(spark, store):
    classified = store.read("prenom_archetype").filter("archetype_id > 0").count()
    assert spark.sql("SELECT count(*) FROM affectation WHERE groupe BETWEEN 1 AND 5").first()[0] == classified


def test_a_missing_table_names_its_stage(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="run the national stage first"):
        TableStore(spark, str(tmp_path)).read("d_prenom")


def test_a_landed_register_is_scanned_by_level(spark, source, tmp_path, capsys):
    from trajecta.sources.register import department_rows, land_register

    landed = land_register(source, str(tmp_path / "landed"))
    department_rows(landed).explain("formatted")
    assert "PartitionFilters: [isnotnull(niveau_geographique" in capsys.readouterr().out
    assert department_rows(landed).exceptAll(department_rows(source)).isEmpty()
    assert department_rows(landed).count() == department_rows(source).count()


def test_an_altered_source_stops_the_run(spark, paths, tmp_path):
    manifest = spark.createDataFrame(
        [("prenoms", 2025, "u", "f", 1, "0" * 64, None)],
        "nom string, millesime int, url string, fichier string, octets bigint, sha256 string,"
        " date_telechargement string",
    )
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(json.loads(manifest_document(manifest).first()[0])), encoding="utf-8")
    with pytest.raises(ValueError, match="prenoms"):
        stages.run(spark, paths["register"], paths["codes"], str(tmp_path / "o"), SETTINGS, str(path))


# --- planted faults: each must fire its check, before anything is exported -------------


def _geography(store, register, spark, paths, out):
    for table in ("d_prenom", "d_annee"):
        store.read(table).write.parquet(f"{out}/{table}")
    codes = stages.read_code_list(spark, paths["codes"])
    return stages.run_geography(TableStore(spark, out), register, codes)


def test_a_forgotten_level_filter_is_caught(spark, store, source, paths, tmp_path):
    mixed = source.withColumn(
        "niveau_geographique",
        F.when(F.col("niveau_geographique") == "REG", "DEP").otherwise(F.col("niveau_geographique")),
    )
    tables = {n: from_contract(n, store.read(n)) for n in TABLES}
    bad = stages.geography_tables(mixed, stages.read_code_list(spark, paths["codes"]), tables["d_prenom"])
    failed = quality.report(stages.geography_gate(bad, source)).filter("not passed").collect()
    assert "territorial counts conserved" in {r["check"] for r in failed}


def test_an_unknown_territory_stops_the_export(spark, store, source, paths, tmp_path):
    moved = source.withColumn(
        "geographie", F.when(F.col("geographie") == "2A", "99").otherwise(F.col("geographie"))
    )
    with pytest.raises(AssertionError, match="cells without territory: 1"):
        _geography(store, moved, spark, paths, str(tmp_path))
    assert not (tmp_path / "f_specificite").exists()


def test_a_sentinel_period_stops_the_export(spark, source, tmp_path):
    sentinel = source.limit(0).union(
        source.filter("niveau_geographique = 'FRANCE'").limit(1).withColumn("periode", F.lit("XXXX"))
    )
    with pytest.raises(AssertionError, match="national counts conserved"):
        stages.run_national(TableStore(spark, str(tmp_path)), source.union(sentinel))
    assert not (tmp_path / "d_prenom").exists()


def test_buckets_of_rare_names_are_dropped(spark, source):
    from trajecta.sources.register import national_rows

    bucket = source.limit(1).withColumn("prenom", F.lit("_PRENOMS_RARES")).withColumn(
        "niveau_geographique", F.lit("FRANCE"))
    null = bucket.withColumn("prenom", F.lit(None).cast("string"))
    assert national_rows(bucket.union(null)).count() == 0


def _fires(check):
    (row,) = check.collect()
    return row["violations"]


def _breaks(df, rule):
    return _fires(quality.row_checks(df, rule))


@pytest.fixture(scope="module")
def t(store):
    return {n: from_contract(n, store.read(n)) for n in TABLES}


def test_a_duplicated_key_fires(t):
    fact = t["f_naissances"]
    twice = fact.union(fact.filter("entity_id = 1 AND period = 1950"))
    assert _fires(quality.unique_key(twice, ["entity_id", "period"], "x")) == 1


def test_a_join_on_the_name_alone_fires(t, source):
    from trajecta.sources.register import national_rows

    dim = t["d_prenom"].select("entity", "entity_id")
    doubled = national_rows(source).join(dim, "entity")
    national = source.filter("niveau_geographique = 'FRANCE'")
    assert _fires(quality.same_total(national, "valeur", doubled, "n", "x")) == 1


def test_an_orphan_fires(t):
    dim = t["d_prenom"].filter("entity_id <> 3")
    assert _fires(quality.orphans(t["f_naissances"], dim, ["entity_id"], "x")) == 1


def test_an_incomplete_grid_fires(t):
    holes = t["profil"].filter("NOT (entity_id = 2 AND period = 1960)")
    assert _fires(quality.dense_grid_complete(holes, t["d_annee"], "x")) == 1


def test_a_cell_on_one_side_fires(t):
    cells = t["f_specificite"]
    some = cells.filter("NOT (entity_id = 2 AND territory = '75')")
    check = quality.grains_reconcile(t["f_naissances_dep"], "n", some, "observed", ["entity_id", "territory"], "x")
    assert _fires(check) == 1


def test_an_empty_table_does_not_pass(t):
    empty = t["f_specificite"].filter("false")
    assert _fires(quality.same_total(t["f_specificite"], "observed", empty, "observed", "x")) == 1
    assert _fires(quality.sparsity(empty, "x")) == 1
    assert _fires(quality.median_index(empty, "x")) == 1


def test_other_faults_fire(t, spark):
    one = t["f_naissances"].filter("entity_id = 1").limit(1)
    assert _breaks(one.withColumn("n", F.lit(12)), quality.not_multiple("n", 5, "x")) == 1
    assert _fires(quality.period_range(t["d_annee"], 1901, 2025, "x")) == 1
    assert _fires(quality.distinct_codes(t["d_prenom"], "grp", 3, "x")) == 1
    assert _fires(quality.missing_codes(t["d_departement"], "territory", ["2A", "20"], "x")) == 1
    raw = t["d_prenom"].withColumn("search", F.lower("entity"))
    assert _breaks(raw, quality.not_normalised("search", "x")) > 0
    blank = t["d_departement"].withColumn("label", F.lit(" "))
    assert _breaks(blank, quality.blank("label", "x")) == 101
    wrong = t["traits"].withColumn("ongoing", ~F.col("ongoing"))
    definition = F.col("peak_period") >= 2016
    assert _breaks(wrong, quality.flag_coherent(F.col("ongoing"), definition, "x")) == wrong.count()
    bridge = t["prenom_archetype"]
    assert _fires(quality.membership(bridge.withColumn("archetype", F.lit(0)), t["traits"], "x")) == t["traits"].count()
    assert _fires(quality.empty_groups(t["d_archetype"], bridge.filter("archetype <> 2"), "x")) == 1
    assert _breaks(bridge.withColumn("distance", F.lit(-1.0)), quality.distance_coherent("x")) == bridge.count()
    assert _breaks(t["traits"].withColumn("recency", F.lit(1.5)), quality.outside(["recency"], 0, 1, "x")) > 0
    assert _breaks(t["f_specificite"].withColumn("expected", F.lit(0.0)), quality.not_positive(["expected"], "x")) > 0
    assert _fires(quality.ineligible(t["profil"], t["d_prenom"], 10**9, "x")) == t["traits"].count()
    assert _fires(quality.label_count(("a",), 2, t["d_archetype"], "x")) == 1
    cells = t["f_specificite"]
    assert _fires(quality.less_total(cells, "observed", cells, "observed", "x")) == 1
    assert _fires(quality.sparsity(cells.withColumn("expected", F.col("expected") * 0.5), "x")) == 1
    assert _fires(quality.median_index(cells.withColumn("expected", F.col("expected") * 2), "x")) == 1
    halves = t["profil"].withColumn("share", F.col("share") / 2)
    assert _fires(quality.sums_to_one(halves, ["entity_id"], "share", "x")) == t["traits"].count()


def test_settings_need_one_label_per_group():
    with pytest.raises(ValueError, match="5 labels for 4 groups"):
        Settings(groups=4)


def _files_below(folder):
    return [p for p in folder.rglob("*") if p.is_file()]


def test_a_stage_writes_its_tables_once_and_leaves_no_scratch(spark, tmp_path, monkeypatch):
    from trajecta import session

    written = []
    materialise = session.materialise
    scratch = tmp_path / "scratch"
    monkeypatch.setattr(session, "scratch_dir", lambda _: str(scratch))
    monkeypatch.setattr(stages.TableStore, "stage", lambda self, t, f=stages.TableStore.stage: written.append(sorted(t)) or f(self, t))
    source = spark.createDataFrame(
        [("FRANCE", "XX", "1", "ANNE", str(y), 10, 1) for y in range(1990, 2000)],
        "niveau_geographique string, geographie string, sexe string, prenom string, periode string, valeur long, rang int",
    )
    store = stages.TableStore(spark, str(tmp_path / "out"))
    assert materialise is session.materialise
    stages.run_national(store, source)
    assert written == [["d_annee", "d_prenom", "d_sexe", "f_naissances"]]
    assert not scratch.exists() or not _files_below(scratch)
    before = {p.name for p in (tmp_path / "out").iterdir()}
    assert before == {"d_annee", "d_prenom", "d_sexe", "f_naissances", "_commits"}
    # A failing gate publishes nothing and leaves nothing behind.
    sentinel = spark.createDataFrame([("FRANCE", "XX", "1", "ANNE", "XXXX", 10, 1)], source.schema)
    with pytest.raises(Exception, match="conserved"):
        stages.run_national(store, source.union(sentinel))
    assert {p.name for p in (tmp_path / "out").iterdir()} == before
    assert not scratch.exists() or not _files_below(scratch)


def test_the_gate_fires_only_on_a_broken_rule(spark):
    fine = spark.createDataFrame([("a", 0)], "check string, violations long")
    broken = spark.createDataFrame([("b", 3)], "check string, violations long")
    stages.quality.gate(stages.quality.report([fine]))
    with pytest.raises(Exception, match="b"):
        stages.quality.gate(stages.quality.report([fine, broken]))
