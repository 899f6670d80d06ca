"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

Totals are additive: an insert adds a document's counts, a delete takes them away, a revision
does both.  Each batch is summed to one row per key and committed once under its id; committing
the same id again changes nothing, so a batch can be replayed after any failure.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, versions: Mapping[str, str]) -> DataFrame:
    """``(doc_id, source, lang, version, n_tokens)``: matches of each version's pattern in the
    whole text; 0 for null.  A row for each version, so ``docs`` is read once."""
    counted = F.array(
        *[
            F.struct(
                F.lit(name).alias("version"),
                F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long").alias("n_tokens"),
            )
            for name, pattern in versions.items()
        ]
    )
    return docs.select("doc_id", "source", "lang", F.inline(counted))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Deltas of inserts (1) or deletes (-1)."""
    return counts.select(
        *KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens")
    )


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace the counts ``old`` by ``new``; a document may change its keys."""
    return signed(old, -1).union(signed(new, 1))


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Committed batches in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._file("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        """The marker is written last, after all files have their final names."""
        return self._system().exists(self._file(f"batch={batch}/_SUCCESS"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add the deltas of ``batch``; False, and nothing changes, if it was added before.

        What a failed attempt left is overwritten.  Null sources and languages are keys of their
        own.  An empty batch is committed as well.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch!r} must be letters, digits, - and _")
        if self.committed(batch):
            return False
        _summed(deltas).write.mode("overwrite").option(
            "mapreduce.fileoutputcommitter.marksuccessfuljobs", "true"
        ).parquet(f"{self.path}/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``(source, lang, version, n_docs, n_tokens)`` over all committed batches; keys whose
        documents are all gone are left out.  No rows before the first commit."""
        system, root = self._system(), self._file("")
        folders = [s.getPath().getName() for s in system.listStatus(root)] if system.exists(root) else []
        done = [f for f in sorted(folders) if f.startswith("batch=") and self.committed(f.removeprefix("batch="))]
        if not done:
            return self.spark.createDataFrame([], _SCHEMA)
        # A few rows per batch, whatever the number of documents.
        parts = [self.spark.read.schema(_SCHEMA).parquet(f"{self.path}/{f}") for f in done]
        return _summed(reduce(DataFrame.union, parts)).filter("n_docs <> 0 OR n_tokens <> 0")
