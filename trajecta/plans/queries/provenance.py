"""Fingerprints, manifests and map coverage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.plans import observations as obs
from trajecta.plans.catalog import registered
from trajecta.session import scratch_dir
from trajecta.sources import provenance, shapes
from trajecta.sources.manifest_log import ManifestLog


@registered("file_fingerprints")
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, size and SHA-256 of every file of the data set."""
    return provenance.fingerprints(spark, sf_dir).select("fichier", "octets", "sha256")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of its source, where many files are alike; the English ones count as
    freshly downloaded, and the first one is declared but has no file."""
    fresh = F.when(F.col("lang") == "en", "2026-01-02T00:00:00+00:00")
    return obs.table(spark, sf_dir, "documents").select(
        F.col("source").alias("nom"),
        F.col("doc_id").cast("string").alias("fichier"),
        F.when(F.col("doc_id") > 0, F.octet_length("text").cast("long")).alias("octets"),
        F.when(F.col("doc_id") > 0, F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha256"),
        fresh.alias("date_telechargement"),
    )


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents were known before; those of low quality had another content."""
    known = obs.table(spark, sf_dir, "documents").join(obs.table(spark, sf_dir, "labels"), "doc_id")
    before = F.when(F.col("quality") == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return known.select(
        F.col("source").alias("nom"),
        F.col("doc_id").cast("string").alias("fichier"),
        F.octet_length(before).cast("long").alias("octets"),
        F.sha2(F.encode(before, "UTF-8"), 256).alias("sha256"),
        F.lit("2025-06-01T00:00:00+00:00").alias("date_telechargement"),
    )


_MANIFESTS = """
current_ AS (
  SELECT source AS nom, CAST(doc_id AS VARCHAR) AS fichier,
         CASE WHEN doc_id > 0 THEN CAST(strlen(text) AS BIGINT) END AS octets,
         CASE WHEN doc_id > 0 THEN sha256(text) END AS sha256,
         CASE WHEN lang = 'en' THEN '2026-01-02T00:00:00+00:00' END AS date_telechargement
  FROM documents),
previous_ AS (
  SELECT source AS nom, CAST(doc_id AS VARCHAR) AS fichier,
         CAST(strlen(CASE WHEN quality = 0 THEN text || '.' ELSE text END) AS BIGINT) AS octets,
         sha256(CASE WHEN quality = 0 THEN text || '.' ELSE text END) AS sha256,
         '2025-06-01T00:00:00+00:00' AS date_telechargement
  FROM documents JOIN labels USING (doc_id)),
upserted AS (
  SELECT c.nom, c.fichier, c.octets, c.sha256,
         COALESCE(c.date_telechargement, p.date_telechargement) AS date_telechargement
  FROM current_ c LEFT JOIN previous_ p
    ON p.nom IS NOT DISTINCT FROM c.nom AND p.fichier = c.fichier AND p.sha256 = c.sha256)"""


@registered("manifest_upsert", f"WITH {_MANIFESTS} SELECT * FROM upserted")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of many files, with files that are alike on both sides."""
    return provenance.upsert_manifest(_current(spark, sf_dir), _previous(spark, sf_dir))


@registered(
    "manifest_changes",
    f"""WITH {_MANIFESTS}
    SELECT *, 'added' AS change FROM (SELECT * FROM upserted EXCEPT ALL SELECT * FROM previous_)
    UNION ALL
    SELECT *, 'removed' AS change FROM (SELECT * FROM previous_ EXCEPT ALL SELECT * FROM upserted)""",
)
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _previous(spark, sf_dir)
    return provenance.manifest_changes(provenance.upsert_manifest(_current(spark, sf_dir), old), old)


@registered(
    "manifest_log",
    f"""WITH {_MANIFESTS}, kept AS (SELECT * FROM upserted WHERE octets % 7 <> 0)
    SELECT nom, fichier, octets, sha256, date_telechargement,
           CASE WHEN EXISTS (SELECT 1 FROM upserted u WHERE u.octets % 7 = 0 OR u.octets IS NULL) THEN 3 ELSE 2 END AS batches
    FROM kept""",
)
def manifest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a log after five runs: a first one, a download, the same again twice, and one that
    no longer finds the files whose size is a multiple of seven.  Runs without news add no batch."""

    def entries(rows: DataFrame) -> DataFrame:
        return rows.select("nom", F.lit(2026).alias("millesime"), F.lit("u").alias("url"), "fichier", "octets", "sha256", "date_telechargement")

    log = ManifestLog(spark, f"{scratch_dir(spark)}/manifest-log-{uuid.uuid4().hex}")
    log.append(entries(_previous(spark, sf_dir)))
    current = entries(_current(spark, sf_dir))
    for _ in range(3):
        log.append(provenance.upsert_manifest(current, log.latest()))
    log.append(provenance.upsert_manifest(current.filter("octets % 7 <> 0"), log.latest()))
    return log.latest().drop("millesime", "url").withColumn("batches", F.lit(len(log.batches())))


@registered(
    "provenance_status",
    f"""WITH {_MANIFESTS}
    SELECT c.nom, c.fichier,
           CASE WHEN c.sha256 IS NULL THEN 'missing'
                WHEN c.nom NOT IN (SELECT nom FROM previous_) THEN 'unknown'
                WHEN EXISTS (SELECT 1 FROM previous_ p WHERE p.nom = c.nom AND p.sha256 = c.sha256) THEN 'match'
                ELSE 'mismatch' END AS status
    FROM current_ c""",
)
def provenance_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = provenance.provenance_status(_current(spark, sf_dir), _previous(spark, sf_dir))
    return status.select("nom", "fichier", "status")


_LANDED = "SELECT lang, string_agg(text || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY lang"


@registered(
    "landed_file_fingerprints",
    f"""SELECT lang, CAST(strlen(content) AS BIGINT) AS octets, sha256(content) AS sha256 FROM ({_LANDED})""",
)
def landed_file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and SHA-256 of text files that hold all documents of a language, as they lie on disk.

    A file lies in parts, each with a range of its documents, so no task sorts or writes a language.
    """
    folder = f"{scratch_dir(spark)}/landed-{uuid.uuid4().hex}"
    texts = obs.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    ranges = texts.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    ranges.select("text", "lang").write.partitionBy("lang").text(folder)
    found = provenance.fingerprints(spark, folder, in_parts=True)
    return found.select(F.regexp_extract("fichier", "lang=([^/]*)", 1).alias("lang"), "octets", "sha256")


@registered(
    "map_shapes_from_files",
    f"""WITH {obs.CODE_LIST}
    SELECT territory, 'no_shape' AS gap FROM codes WHERE territory < '05'
    UNION ALL
    SELECT 'N' || n_nationkey, 'no_territory' FROM nation WHERE n_nationkey % 6 = 0""",
)
def map_shapes_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a map that is read from TopoJSON files: it lacks the first territories, and has
    shapes that nobody knows."""
    codes = obs.code_list(spark, sf_dir)
    stray = obs.table(spark, sf_dir, "nation").filter("n_nationkey % 6 = 0")
    drawn = codes.filter("territory >= '05'").select("territory", "label").unionByName(
        stray.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("territory"), F.col("n_name").alias("label"))
    )
    properties = F.struct(F.col("territory").alias("code"), F.col("label").alias("nom"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.lit(1))).alias("arcs"), properties.alias("properties"))
    # One document for each first character, so that a map may be a folder of files.
    maps = drawn.groupBy(F.left("territory", F.lit(1)).alias("sheet")).agg(F.collect_list(shape).alias("geometries"))
    objects = F.struct(F.struct(F.lit("GeometryCollection").alias("type"), "geometries").alias("departements"))
    folder = f"{scratch_dir(spark)}/shapes-{uuid.uuid4().hex}"
    maps.select(F.to_json(F.struct(F.lit("Topology").alias("type"), objects.alias("objects"))).alias("value"), "sheet").write.partitionBy(
        "sheet"
    ).text(folder)
    return shapes.map_coverage(shapes.read_shapes(spark, folder), codes)


@registered(
    "map_key_coverage",
    f"""WITH {obs.CODE_LIST}
    SELECT territory, 'no_shape' AS gap FROM codes WHERE length(territory) = 3
    UNION ALL
    SELECT 'R' || r_regionkey AS territory, 'no_territory' AS gap FROM region""",
)
def map_key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topology document of the two-character territories and of shapes nobody knows."""
    codes = obs.code_list(spark, sf_dir)
    stray = obs.table(spark, sf_dir, "region").select(
        F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("territory"),
        F.col("r_name").alias("label"),
    )
    drawn = codes.filter(F.length("territory") == 2).select("territory", "label").unionByName(stray)
    properties = F.struct(F.col("territory").alias("code"), F.col("label").alias("nom"))
    shape = F.struct(F.lit("Polygon").alias("type"), properties.alias("properties"))
    objects = F.struct(F.struct(F.array(shape).alias("geometries")).alias("departements"))
    document = F.to_json(F.struct(F.lit("Topology").alias("type"), objects.alias("objects")))
    parsed = drawn.select(F.from_json(document, shapes.TOPOLOGY).alias("d")).select("d.*")
    return shapes.map_coverage(shapes.shape_codes(parsed), codes)
