import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trajecta import session
from trajecta.plans import stages
from trajecta.plans.catalog import QUERIES
import trajecta.plans.queries  # noqa: F401  (registers the queries)
from trajecta.sources import digests, provenance, shapes
from trajecta.sources.manifest_log import ManifestLog, differences
from trajecta.sources.register import clean_rows, read_code_list, read_register


@pytest.fixture()
def files(tmp_path):
    for name, content in (("a.bin", b"x" * 5000), ("b.bin", b"0"), ("c.bin", b"yz")):
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_fingerprints_of_all_files(spark, files):
    (files / "sub").mkdir()
    for name, content in (("sub/a.bin", b"other"), ("empty.bin", b""), ("_SUCCESS", b""), (".hidden", b"h")):
        (files / name).write_bytes(content)
    got = {r["fichier"]: (r["octets"], r["sha256"]) for r in provenance.fingerprints(spark, str(files)).collect()}
    names = ("a.bin", "b.bin", "c.bin", "sub/a.bin", "empty.bin")
    want = {n: ((files / n).stat().st_size, hashlib.sha256((files / n).read_bytes()).hexdigest()) for n in names}
    assert got == want
    (one,) = provenance.fingerprints(spark, str(files / "a.bin")).collect()
    assert (one["fichier"], one["octets"]) == ("a.bin", 5000)
    (none,) = provenance.fingerprints(spark, str(files / "empty.bin")).collect()
    assert none["sha256"] == hashlib.sha256(b"").hexdigest()
    assert provenance.fingerprints(spark, str(files / "absent")).count() == 0


def test_files_beyond_one_value_are_streamed(spark, tmp_path):
    """A sparse file of 3 GB; its zeros take no disk."""
    size = 3 * 1024**3
    with open(tmp_path / "large file.bin", "wb") as file:
        file.seek(size - 1)
        file.write(b"x")
    (tmp_path / "small.bin").write_bytes(b"small")
    want = hashlib.sha256()
    for _ in range(3 * 1024 - 1):
        want.update(bytes(1 << 20))
    want.update(bytes((1 << 20) - 1) + b"x")
    got = {r["fichier"]: (r["octets"], r["sha256"]) for r in provenance.fingerprints(spark, str(tmp_path)).collect()}
    assert got == {"large file.bin": (size, want.hexdigest()), "small.bin": (5, hashlib.sha256(b"small").hexdigest())}


def test_small_files_share_a_task():
    files = [("a", 10), ("b", 300), ("c", 90), ("d", 1), ("e", 0)]
    dealt = digests.shares(files, 100)
    assert dealt == [["b"], ["c", "a"], ["d", "e"]] or sorted(map(sorted, dealt)) == [["a", "c"], ["b"], ["d", "e"]]
    assert digests.shares([]) == []


def test_digests_are_read_in_ranges(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"abcdefg")
    monkeypatch.setattr(digests, "RANGE_BYTES", 3)
    assert digests.digest((tmp_path / "f").as_uri()) == (7, hashlib.sha256(b"abcdefg").hexdigest())


@pytest.mark.parametrize("streamed", [True, False])
def test_parts_of_a_file_are_hashed_in_the_order_of_their_numbers(spark, tmp_path, monkeypatch, streamed):
    for folder, parts in (("lang=en", {"part-00002": b"b", "part-00010": b"c", "part-100000": b"d"}), ("lang=fr", {"part-00000": b"one"})):
        (tmp_path / folder).mkdir()
        for name, content in parts.items():
            (tmp_path / folder / name).write_bytes(content)
    monkeypatch.setattr(provenance, "can_stream", lambda uri: streamed)
    got = {r["fichier"]: (r["octets"], r["sha256"]) for r in provenance.fingerprints(spark, str(tmp_path), in_parts=True).collect()}
    assert got == {"lang=en": (3, hashlib.sha256(b"bcd").hexdigest()), "lang=fr": (3, hashlib.sha256(b"one").hexdigest())}


def test_no_task_writes_the_landed_file_of_a_language(spark, tmp_path, monkeypatch):
    """One language in several tasks, its parts in the order of the documents."""
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(provenance, "_whole", lambda rows, whole=provenance._whole: seen.append(rows) or whole(rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        (one,) = QUERIES["landed_file_fingerprints"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    content = "".join(f"text {i}\n" for i in range(4000)).encode()
    assert (one["lang"], one["octets"], one["sha256"]) == ("en", len(content), hashlib.sha256(content).hexdigest())
    assert len(seen[0]) > 1 and max(size for _, _, size, _ in seen[0]) < len(content) / 2


def _declared(spark, *rows):
    return spark.createDataFrame(
        [(n, 2025, "u", f, None) for n, f in rows],
        "nom string, millesime int, url string, fichier string, date_telechargement string",
    )


def test_a_folder_is_a_source_of_all_its_files(spark, files):
    (files / "parts").mkdir()
    for k in range(3):
        (files / "parts" / f"part-{k}").write_bytes(b"p" * (k + 1))
    found = provenance.fingerprints(spark, str(files))
    entries = provenance.manifest_entries(found, _declared(spark, ("big", "parts"), ("one", "b.bin")))
    assert {(r["nom"], r["fichier"], r["octets"]) for r in entries.collect()} == {
        ("big", "parts/part-0", 1), ("big", "parts/part-1", 2), ("big", "parts/part-2", 3), ("one", "b.bin", 1),
    }


def test_sources_that_lose_their_file_stop_the_stage(spark, files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("out") / "manifest")
    declared = _declared(spark, ("first", "a.bin"), ("second", "c.bin"))
    assert stages.run_sources(spark, declared, str(files), path)
    (files / "a.bin").write_bytes(b"")
    with pytest.raises(ValueError, match=r"without content: first \(a.bin\)"):
        stages.run_sources(spark, declared, str(files), path)
    with pytest.raises(FileNotFoundError, match="first"):
        stages.check_sources(spark, path, first=str(files / "a.bin"))
    (files / "a.bin").unlink()
    (files / "c.bin").unlink()
    with pytest.raises(ValueError, match=r"first \(a.bin\), second \(c.bin\)"):
        stages.run_sources(spark, declared, str(files), path)
    # The manifest still knows both, so other content does not pass as a first run.
    assert provenance.read_manifest(spark, path).count() == 2
    (files / "a.bin").write_bytes(b"altered")
    with pytest.raises(ValueError, match="first: expected"):
        stages.check_sources(spark, path, first=str(files / "a.bin"))


def test_a_single_stage_refuses_an_altered_register(spark, tmp_path, monkeypatch):
    from trajecta import __main__ as cli

    spark.range(3).write.parquet(str(tmp_path / "register"))
    (tmp_path / "declared.csv").write_text("nom,millesime,url,fichier,date_telechargement\nprenoms,2025,u,register,\n")

    def call(*args):
        monkeypatch.setattr("sys.argv", ["trajecta", *args])
        cli.main()

    manifest = str(tmp_path / "manifest")
    call("sources", "--declared", str(tmp_path / "declared.csv"), "--folder", str(tmp_path), "--manifest", manifest)
    part = next((tmp_path / "register").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "register" / f".{part.name}.crc").unlink()
    stage = ["--register", str(tmp_path / "register"), "--out", str(tmp_path / "out"), "--manifest", manifest]
    with pytest.raises(ValueError, match="prenoms: expected"):
        call("national", *stage)
    with pytest.raises(SystemExit):
        call("geography", *stage)


ENTRY = ("nom string, millesime int, url string, fichier string, octets bigint, sha256 string,"
         " date_telechargement string")


def _entries(spark, *rows):
    return spark.createDataFrame([(n, 2025, "u", "f", 1, sha, date) for n, sha, date in rows], ENTRY)


def test_upsert_keeps_a_date_only_for_the_same_content(spark):
    old = _entries(spark, ("a", "1", "2020"), ("b", "1", "2020"), ("c", "1", "2020"))
    now = _entries(spark, ("a", "1", None), ("b", "2", None), ("c", "1", "2026"), ("d", "9", None))
    got = {r["nom"]: r["date_telechargement"] for r in provenance.upsert_manifest(now, old).collect()}
    assert got == {"a": "2020", "b": None, "c": "2026", "d": None}


def test_manifest_is_rewritten_only_on_a_change(spark):
    old = _entries(spark, ("a", "1", "2020"), ("b", "1", None))
    assert provenance.manifest_changes(old, old).count() == 0
    new = _entries(spark, ("a", "2", "2020"), ("b", "1", None))
    assert {(r["nom"], r["change"]) for r in provenance.manifest_changes(new, old).collect()} == {
        ("a", "added"), ("a", "removed"),
    }


def test_manifest_document_round_trip(spark, tmp_path):
    old = _entries(spark, ("a", "1", "2020"), ("é", "2", None))
    path = tmp_path / "manifest.json"
    path.write_text(provenance.manifest_document(old).first()[0], encoding="utf-8")
    back = provenance.read_manifest(spark, str(path))
    assert back.columns == list(provenance.ENTRY)
    assert provenance.manifest_changes(back, old).count() == 0


def test_the_sources_stage_dates_only_what_it_knows(spark, files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("out") / "manifest")

    def declared(date):
        return spark.createDataFrame(
            [("first", 2025, "u1", "a.bin", date), ("second", 2026, "u2", "c.bin", None)],
            "nom string, millesime int, url string, fichier string, date_telechargement string",
        )

    def dates():
        rows = provenance.read_manifest(spark, path).collect()
        return {r["nom"]: (r["octets"], r["date_telechargement"]) for r in rows}

    assert stages.run_sources(spark, declared("2026-01-01"), str(files), path)
    assert dates() == {"first": (5000, "2026-01-01"), "second": (2, None)}
    # Nothing changed: the date is kept and the manifest not written again.
    assert not stages.run_sources(spark, declared(None), str(files), path)
    (files / "a.bin").write_bytes(b"other")
    with pytest.raises(ValueError, match="first: expected"):
        stages.check_sources(spark, path, first=str(files / "a.bin"))
    stages.check_sources(spark, path, second=str(files / "c.bin"), third=str(files / "a.bin"))
    assert stages.run_sources(spark, declared(None), str(files), path)
    assert dates()["first"] == (5, None)
    stages.check_sources(spark, str(files / "no-manifest"), first=str(files / "a.bin"))


def test_equal_files_of_a_source_do_not_multiply(spark, files, tmp_path_factory):
    """Four runs over a folder with two files that are alike keep two entries, and write once."""
    (files / "parts").mkdir()
    for k in range(2):
        (files / "parts" / f"part-{k}").write_bytes(b"the same")
    path = str(tmp_path_factory.mktemp("out") / "manifest")
    declared = _declared(spark, ("twins", "parts"), ("twins", "parts"))
    written = []
    for _ in range(4):
        written.append(stages.run_sources(spark, declared, str(files), path))
        rows = provenance.read_manifest(spark, path).collect()
        assert [(r["nom"], r["fichier"]) for r in rows] == [("twins", "parts/part-0"), ("twins", "parts/part-1")]
    assert written == [True, False, False, False]
    assert provenance.manifest_log(spark, path).batches() == [1]


def test_a_manifest_without_a_log_begins_one(spark, files, tmp_path):
    """A document from elsewhere keeps its dates, and is not written again if nothing changed."""
    path = tmp_path / "manifest"
    declared = _declared(spark, ("first", "a.bin"))
    entries = provenance.manifest_entries(provenance.fingerprints(spark, str(files)), declared)
    document = provenance.manifest_document(entries.drop("date_telechargement").selectExpr("*", "'2020' AS date_telechargement"))
    path.write_text(document.first()[0], encoding="utf-8")
    assert not stages.run_sources(spark, declared, str(files), str(path))
    assert [r["date_telechargement"] for r in provenance.stored_manifest(spark, str(path)).collect()] == ["2020"]
    (files / "a.bin").write_bytes(b"new")
    assert stages.run_sources(spark, declared, str(files), str(path))
    assert [r["date_telechargement"] for r in provenance.stored_manifest(spark, str(path)).collect()] == [None]


def test_the_log_keeps_the_latest_entry_and_forgets_what_is_gone(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "log"))

    def entries(*rows):
        return spark.createDataFrame([(n, 2025, "u", f, 1, sha, None) for n, f, sha in rows], ENTRY)

    def state():
        return sorted((r["nom"], r["fichier"], r["sha256"]) for r in log.latest().collect())

    first = [("a", "x", "1"), ("a", "y", "1"), ("b", "x", "2"), (None, "x", "3")]
    assert log.latest().count() == 0 and not log.append(entries())
    assert log.append(entries(*first)) and not log.append(entries(*first))
    assert differences(entries(*first), log.latest()).count() == 0
    second = [("a", "x", "1"), ("a", "y", "9"), (None, "x", "3")]
    assert log.append(entries(*second)) and log.rows().count() == 4 + 2
    assert [(r.nom, r.fichier, r.gone) for r in log.rows().filter("batch = 2").orderBy("nom").collect()] == [
        ("a", "y", False), ("b", "x", True),
    ]
    # A batch that was not committed is none, and the next one takes its number.
    broken = tmp_path / "log" / "batch=3"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    want = sorted(second, key=lambda r: (r[0] or "", r[1]))
    assert sorted((r["nom"] or "", r["fichier"], r["sha256"]) for r in log.latest().collect()) == [(n or "", f, s) for n, f, s in want]
    third = [("b", "x", "2")]
    assert log.append(entries(*third)) and log.batches() == [1, 2, 3] and state() == third
    log.compact()
    assert log.batches() == [4] and state() == third and not log.append(entries(*third))


def test_provenance_gate(spark):
    found = _entries(spark, ("a", "1", None), ("b", "2", None), ("new", "3", None)).select("nom", "sha256")
    manifest = _entries(spark, ("a", "1", None), ("b", "1", None))
    status = provenance.provenance_status(found, manifest)
    assert {r["nom"]: r["status"] for r in status.collect()} == {"a": "match", "b": "mismatch", "new": "unknown"}
    two_files = _entries(spark, ("b", "1", None), ("b", "2", None))
    assert {r["status"] for r in provenance.provenance_status(found, two_files).collect()} == {"match", "unknown"}
    provenance.require_provenance(status.filter("nom <> 'b'"))
    with pytest.raises(ValueError, match="b: expected 1, found 2"):
        provenance.require_provenance(status)


def test_code_list_keeps_text_and_ignores_extra_columns(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text('REG,NCC,DEP,LIBELLE\n01,X,01,"Ain, l\'"\n94,Y,2A,Corse\n', encoding="utf-8")
    rows = [tuple(r) for r in read_code_list(spark, str(path)).collect()]
    assert rows == [("01", "Ain, l'", "01"), ("2A", "Corse", "94")]


REGISTER = "niveau_geographique string, geographie string, sexe string, prenom string, periode string, valeur string, rang int"


@pytest.mark.parametrize("level", ["DEP", "FRANCE"])
def test_values_that_do_not_fit_are_refused_and_sentinels_dropped(spark, level):
    good = (level, "01", "1", "ANNE", "1999", "5", 1)

    def rows(*extra):
        return clean_rows(spark.createDataFrame([good, *extra], REGISTER), level).collect()

    dropped = [(level, "01", "1", "ANNE", "XXXX", "5", 1), (level, "01", "X", "_RARE", "40000", "5", 1)]
    other = [("REG", "01", "X", "ANNE", "40000", "5", 1)]
    assert [tuple(r) for r in rows(*dropped, *other)] == [(1, "ANNE", 1999, "01", 5, 1)]
    for fate, bad in (
        ("bad_period", (level, "01", "1", "ANNE", "40000", "5", 1)),
        ("bad_group", (level, "01", "X", "ANNE", "1999", "5", 1)),
        ("bad_count", (level, "01", "1", "ANNE", "1999", "many", 1)),
    ):
        with pytest.raises(Exception, match=f"refused: {fate}"):
            rows(bad)


def test_register_without_a_column_is_refused(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError, match="lacks the columns niveau_geographique"):
        read_register(spark, str(tmp_path / "r"))


def test_map_coverage(spark, tmp_path):
    def shape(code):
        return {"type": "Polygon", "id": code, "properties": {"code": code, "nom": code}, "arcs": [[1, -2]]}

    topology = {"type": "Topology", "arcs": [[[0, 1]]], "objects": {"departements": {
        "type": "GeometryCollection", "geometries": [shape("01"), shape("2A"), shape("ZZ")]}}}
    path = tmp_path / "map.json"
    path.write_text(json.dumps(topology, indent=1), encoding="utf-8")
    known = spark.createDataFrame([("01",), ("2A",), ("971",)], "territory string")
    gaps = shapes.map_coverage(shapes.read_shapes(spark, str(path)), known)
    assert {tuple(r) for r in gaps.collect()} == {("971", "no_shape"), ("ZZ", "no_territory")}


class _Cluster:
    """Stands in for a session on a cluster without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "yarn"
        applicationId = "app"

        @staticmethod
        def getConf():
            return {}

        @staticmethod
        def getCheckpointDir():
            return None


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_dir(_Cluster)
    assert session.scratch_dir(spark) == spark.conf.get("spark.checkpoint.dir")
