"""Fingerprints of source files and the manifest they are checked against."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.sources.digests import can_stream, read_digests
from trajecta.sources.manifest_log import KEY, ManifestLog, one_entry_each

MANIFEST = (
    "sources array<struct<nom:string,millesime:int,url:string,fichier:string,"
    "octets:bigint,sha256:string,date_telechargement:string>>"
)
ENTRY = ("nom", "millesime", "url", "fichier", "octets", "sha256", "date_telechargement")

LONGEST_LOG = 32  # batches of a manifest log before it is compacted
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def _listing(spark: SparkSession, path: str) -> list[tuple]:
    """Every file under ``path``, or the file itself, as Spark's storage layer lists it, with the
    place where it really lies.

    Files and folders whose names start with ``_`` or ``.`` are left out, as Spark leaves them
    out when it reads.  ``fichier`` is the path below ``path``, so equal names in two folders
    stay apart.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    # A mount point stands for the storage behind it.
    root = system.resolvePath(root)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = root.toUri().getPath().rstrip("/")
    rows, files = [], system.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        uri = status.getPath().toUri()
        below = uri.getPath()[len(base) :].lstrip("/")
        if any(part[0] in "_." for part in below.split("/") if part):
            continue
        rows.append((uri.toString(), below or status.getPath().getName(), status.getLen(), status.getModificationTime()))
    return rows


def _whole(rows: list[tuple]) -> tuple[list[tuple], dict[str, list[str]]]:
    """The files of each folder of a listing as one, and its parts in their order.

    Numbers of parts are padded with zeros up to some length, so a longer name comes later.
    """
    folders: dict[tuple[str, str], list[tuple]] = {}
    for row in rows:
        folders.setdefault((row[0].rpartition("/")[0], row[1].rpartition("/")[0]), []).append(row)
    files, parts = [], {}
    for (uri, name), held in folders.items():
        held.sort(key=lambda row: (len(row[0]), row[0]))
        files.append((uri, name, sum(row[2] for row in held), max(row[3] for row in held)))
        parts[uri] = [row[0] for row in held]
    return files, parts


def fingerprints(spark: SparkSession, path: str, *, in_parts: bool = False) -> DataFrame:
    """Path, name, size, SHA-256 and modification time of every file under ``path``.

    ``in_parts`` takes the files of one folder, as tasks write them, for the parts of one file in
    the order of their numbers; it goes by the name of the folder.

    The listing comes from the storage layer and holds empty files as well.  Contents are streamed
    through the tasks, whatever the size of a file.  Where only the JVM reads the storage, a file
    is one value, and Spark refuses, by name, one of more than 2 GB.
    """
    rows, parts = [(uri, name, size, ms / 1000.0) for uri, name, size, ms in _listing(spark, path)], {}
    if in_parts:
        rows, parts = _whole(rows)
    listed = spark.createDataFrame(rows, "path string, fichier string, octets bigint, seconds double").select(
        "path", "fichier", "octets", F.col("seconds").cast("timestamp").alias("modified")
    )
    full = [(uri, size) for uri, _, size, _ in rows if size]
    if all(can_stream(uri) for uri, _ in full):
        hashed = read_digests(spark, full, parts).select(_location(F.col("path")).alias("at"), F.col("sha256").alias("hash"))
    else:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        hashed = content.select(_location(F.col("path")).alias("at"), "content")
        if in_parts:
            joined = F.expr("listagg(content) WITHIN GROUP (ORDER BY struct(length(at), at))")
            hashed = hashed.groupBy(F.regexp_replace("at", "/[^/]*$", "").alias("folder")).agg(joined.alias("content"))
            hashed = hashed.withColumnRenamed("folder", "at")
        hashed = hashed.select("at", F.sha2("content", 256).alias("hash"))
    whole = listed.join(hashed, _location(F.col("path")) == F.col("at"), "left")
    return whole.select(
        "fichier",
        "octets",
        F.when(F.col("octets") == 0, F.lit(EMPTY_HASH)).otherwise(F.col("hash")).alias("sha256"),
        "modified",
        "path",
    )


def _location(uri: Column) -> Column:
    """Path of a file without scheme and authority, which layers write in different ways."""
    return F.regexp_replace(uri, "^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source of a manifest document."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline("sources"))


def read_declared(spark: SparkSession, path: str) -> DataFrame:
    """Declared sources from a CSV with a header; an empty date is null."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(
        "nom", F.col("millesime").cast("int").alias("millesime"), "url", "fichier", "date_telechargement"
    )


def manifest_document(entries: DataFrame) -> DataFrame:
    """The manifest as one JSON document; its size is the number of declared sources."""
    rows = F.array_sort(F.collect_list(F.struct(*ENTRY)))
    return entries.agg(F.to_json(F.struct(rows.alias("sources"))).alias("value"))


def manifest_log(spark: SparkSession, path: str) -> ManifestLog:
    """The log behind the manifest document at ``path``, beside it."""
    return ManifestLog(spark, f"{path.rstrip('/')}.log")


def stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of an earlier run, or no entries before the first one.

    A document without a log is one that came from elsewhere, and is where a log begins.
    """
    log = manifest_log(spark, path)
    if log.batches():
        return log.latest()
    try:
        return read_manifest(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST).select(F.inline("sources"))


def manifest_entries(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared sources with the size and hash measured on their files.

    ``declared`` has nom, millesime, url, fichier and date_telechargement (null for a file
    that was already there).  A ``fichier`` that is a folder gives an entry for each file below
    it.  Every declared source comes back; one without a file has neither size nor hash.
    """
    parts = F.split("file", "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    below = found.select(F.col("fichier").alias("file"), "octets", "sha256")
    below = below.withColumn("fichier", F.explode(upto))
    return (
        declared.join(below, "fichier", "left")
        .withColumn("fichier", F.coalesce("file", "fichier"))
        .select(*ENTRY)
    )


def require_content(entries: DataFrame) -> None:
    """Stop if a declared source has no file or an empty one, naming each."""
    bare = entries.filter("sha256 IS NULL OR octets = 0").select("nom", "fichier").distinct().orderBy("nom", "fichier")
    names = [f"{r['nom']} ({r['fichier']})" for r in bare.collect()]  # declared sources at most
    if names:
        raise ValueError(f"declared sources without content: {', '.join(names)}")


def save_manifest(entries: DataFrame, path: str) -> bool:
    """Bring the log up to ``entries`` and write the document anew, unless nothing changed; says
    whether it was written.  A log that has grown long is compacted."""
    spark = entries.sparkSession
    log = manifest_log(spark, path)
    if not log.batches():
        # The first batch holds all, also where a document says the same.
        same = manifest_changes(one_entry_each(entries), stored_manifest(spark, path)).isEmpty()
        log.append(entries)
    else:
        same = not log.append(entries)
    if len(log.batches()) > LONGEST_LOG:
        log.compact()
    if same:
        return False
    manifest_document(log.latest()).coalesce(1).write.mode("overwrite").text(path)
    return True


def upsert_manifest(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Keep an earlier download date only where the content is unchanged.

    Entries are told apart by source and file.  ``current`` carries the date of this run for a fresh
    file and null for one that was already there; a changed hash makes the old date wrong, so it is
    dropped.  An entry listed more than once on either side counts once.
    """
    earlier = (
        previous.groupBy(*KEY, "sha256").agg(F.max("date_telechargement").alias("_earlier")).withColumnsRenamed(
            {k: f"_{k}" for k in (*KEY, "sha256")}
        )
    )
    same_key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    same = same_key[0] & same_key[1] & (F.col("sha256") == F.col("_sha256"))
    kept = F.coalesce("date_telechargement", "_earlier")
    return (
        one_entry_each(current)
        .join(earlier, same, "left")
        .withColumn("date_telechargement", kept)
        .select(*current.columns)
    )


def manifest_changes(new: DataFrame, old: DataFrame) -> DataFrame:
    """Entries on one side only; empty means the manifest need not be written."""
    added = new.exceptAll(old.select(*new.columns)).withColumn("change", F.lit("added"))
    removed = old.select(*new.columns).exceptAll(new).withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def provenance_status(found: DataFrame, manifest: DataFrame, key: str = "nom") -> DataFrame:
    """``match``, ``mismatch``, ``missing`` for a source without a file, or ``unknown`` where the
    manifest does not know it.

    A source of several files has one manifest entry per file; each file must match one.
    """
    known = manifest.groupBy(key).agg(F.min("sha256").alias("expected"))
    listed = manifest.select(key, "sha256", F.lit(True).alias("_listed")).distinct()
    status: Column = (
        F.when(F.col("sha256").isNull(), "missing")
        .when(F.col("expected").isNull(), "unknown")
        .when(F.col("_listed"), "match")
        .otherwise("mismatch")
    )
    return (
        found.join(known, key, "left")
        .join(listed, [key, "sha256"], "left")
        .withColumn("status", status)
        .drop("_listed")
    )


def require_provenance(status: DataFrame, key: str = "nom") -> None:
    """Stop on an altered or missing source; an unknown one passes, so a first run is possible.

    The error counts all that is wrong and names the sources.
    """
    wrong = status.filter("status IN ('mismatch', 'missing')")
    by_source = wrong.groupBy(key).agg(
        F.count("*").alias("files"), F.min("expected").alias("expected"), F.min("sha256").alias("found")
    )
    rows = by_source.orderBy(key).collect()  # sources at most
    if rows:
        lines = "; ".join(f"{r[key]}: expected {r['expected']}, found {r['found']} ({r['files']} files)" for r in rows)
        raise ValueError(f"source does not match the manifest: {lines}")
