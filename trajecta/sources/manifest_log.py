"""The manifest as an append-only log of entries, keyed by source and file.

A run appends only what differs from the state before it: entries that are new or altered, and a
mark for each that is gone.  The state is the latest entry of each key, so a run that finds nothing
new leaves no trace, whatever the number of files that are alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.session import materialise
from trajecta.sources.files import Folder

KEY = ("nom", "fichier")
VALUES = ("millesime", "url", "octets", "sha256", "date_telechargement")
ENTRY_SCHEMA = (
    "nom string, millesime int, url string, fichier string, octets bigint, sha256 string, date_telechargement string"
)
_LOG_SCHEMA = f"{ENTRY_SCHEMA}, gone boolean"


def folded(log: DataFrame) -> DataFrame:
    """The latest entry of each key from rows of a log with the number of their ``batch``.

    Summed up in each task first, so a key with a long history is no hot key.
    """
    values = [c for c in log.columns if c not in (*KEY, "batch")]
    latest = log.groupBy(*KEY).agg(F.max_by(F.struct(*values), "batch").alias("latest"))
    return latest.select(*KEY, "latest.*").filter("NOT gone").drop("gone")


def one_entry_each(entries: DataFrame) -> DataFrame:
    """One entry for each key; of several the one whose values sort last."""
    values = [c for c in entries.columns if c not in KEY]
    latest = entries.groupBy(*KEY).agg(F.max(F.struct(*values)).alias("one"))
    return latest.select(*KEY, "one.*").select(*entries.columns)


def differences(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows to append so that ``old`` becomes ``new``: new and altered entries, and keys that are gone."""
    values = [c for c in new.columns if c not in KEY]
    before = one_entry_each(old).select(*(F.col(k).alias(f"_{k}") for k in KEY), F.struct(*values).alias("_before"))
    after = one_entry_each(new).select(*KEY, F.struct(*values).alias("_after"))
    same_key = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    both = after.join(before, same_key[0] & same_key[1], "full")
    gone = F.col("_after").isNull()
    kept = both.filter(~F.col("_after").eqNullSafe(F.col("_before")))
    key = [F.when(gone, F.col(f"_{k}")).otherwise(F.col(k)).alias(k) for k in KEY]
    return kept.select(*key, gone.alias("gone"), F.coalesce("_after", "_before").alias("_entry")).select(
        *KEY, "_entry.*", "gone"
    )


class ManifestLog:
    """Batches of a log in a folder; each is committed once, under the next number."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def batches(self) -> list[int]:
        """Numbers of the committed batches; what a broken run left behind is none."""
        found = [n for n in self.folder.names() if n.startswith("batch=")]
        return [int(n.removeprefix("batch=")) for n in found if self.folder.exists(f"{n}/_SUCCESS")]

    def rows(self) -> DataFrame:
        """All rows with their ``batch``; one scan, whatever the number of batches."""
        paths = [f"{self.folder.root}/batch={n}" for n in self.batches()]
        schema = f"{_LOG_SCHEMA}, batch int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder.root).parquet(*paths)

    def latest(self) -> DataFrame:
        return folded(self.rows()).select("nom", "millesime", "url", "fichier", "octets", "sha256", "date_telechargement")

    def append(self, entries: DataFrame) -> bool:
        """Bring the log up to ``entries``; False, and nothing is written, if they say nothing new."""
        rows = materialise(differences(entries, self.latest()), "manifest-rows")
        if rows.isEmpty():
            return False
        self._write(rows)
        return True

    def compact(self) -> None:
        """Replace all batches by one with the state they add up to.

        The new batch is committed first; the others go from the oldest on, so that no entry
        outlives the mark that it is gone.
        """
        old = self.batches()
        if len(old) > 1:
            self._write(materialise(self.latest().withColumn("gone", F.lit(False)), "manifest-rows"))
            for number in old:
                self.folder.delete(f"batch={number}")

    def _write(self, rows: DataFrame) -> None:
        number = max(self.batches(), default=0) + 1
        target = rows.select(*(F.col(f.name) for f in self.rows().drop("batch").schema))
        target.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(
            f"{self.folder.root}/batch={number}"
        )
