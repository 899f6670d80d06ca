"""Stage-to-stage tables on shared storage, published as snapshots.

Every write of a table goes to a folder of its own below the table's name.  What readers see is told
by the last of the numbered files in ``_commits``, which names the folder of every table.  A stage's
tables are all written and checked before one such file is added, so they change together or, if the
run is killed anywhere before, not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from trajecta.sources.files import Folder

# Which stage writes each table; named in the error when one is missing.
PRODUCERS = {
    "d_prenom": "national",
    "d_annee": "national",
    "d_sexe": "national",
    "f_naissances": "national",
    "profil": "trajectories",
    "traits": "trajectories",
    "d_archetype": "archetypes",
    "prenom_archetype": "archetypes",
    "profil_archetype": "archetypes",
    "d_departement": "geography",
    "f_naissances_dep": "geography",
    "f_specificite": "geography",
}


class ConflictError(RuntimeError):
    """Another run has published one of the same tables since this one began."""


class TableStore:
    """A folder of Parquet tables that the stages hand over to each other."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.folder, self.commits = Folder(spark, self.root), Folder(spark, f"{self.root}/_commits")

    def versions(self) -> list[int]:
        """Numbers of the snapshots, the last one is read."""
        return [int(n.removesuffix(".json")) for n in self.commits.names() if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> dict[str, dict]:
        """Folder, row count and first snapshot of each table of a snapshot; the last if not named."""
        versions = self.versions()
        if version is None and not versions:
            return {}
        return json.loads(self.commits.read(f"{max(versions) if version is None else version:08d}.json"))

    def path(self, table: str, version: int | None = None) -> str:
        """Where a table lies; one that no snapshot knows is a plain folder of that name."""
        known = self.snapshot(version).get(table)
        return f"{self.root}/{known['folder'] if known else table}"

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as a lazy DataFrame and a temporary view of the same name.

        The DataFrame stays with the files of its snapshot, whatever is published later.
        """
        path = self.path(table, version)
        try:
            df = self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            producer = PRODUCERS.get(table, "an earlier")
            raise FileNotFoundError(f"{path} is missing: run the {producer} stage first") from error
        df.createOrReplaceTempView(table)
        return df

    def stage(self, tables: Mapping[str, DataFrame]) -> Staged:
        """Write an explicit list of tables beside the published ones; rows are counted while
        they are written."""
        return Staged(self, tables)

    def write(self, tables: Mapping[str, DataFrame]) -> dict[str, int]:
        """Write and publish at once."""
        with self.stage(tables) as staged:
            return staged.publish()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete what none of the last ``keep`` snapshots names, also what killed runs left.

        To be run while no stage writes; readers of the kept snapshots are not disturbed.
        """
        versions = self.versions()
        kept = versions[-max(1, keep) :]
        named = {entry["folder"] for v in kept for entry in self.snapshot(v).values()}
        for version in versions:
            if version not in kept:
                self.commits.delete(f"{version:08d}.json")
        gone = []
        for table in self.folder.names():
            if table[0] in "_.":
                continue
            for name in Folder(self.spark, f"{self.root}/{table}").names():
                if name.startswith("v-") and f"{table}/{name}" not in named:
                    gone.append(f"{table}/{name}")
                    self.folder.delete(gone[-1])
            self.folder.delete_if_empty(table)
        return gone


class Staged:
    """Tables of a store that no snapshot names yet, until they are published or dropped.

    Used as a context: what is not published when it ends, by an error or not, is deleted.
    """

    def __init__(self, store: TableStore, tables: Mapping[str, DataFrame]) -> None:
        self.store, self.spark = store, store.spark
        self.before = store.snapshot()
        self.folders = {name: f"{name}/v-{uuid.uuid4().hex}" for name in tables}
        self.rows: dict[str, int] = {}
        self.published = False
        try:
            for name, df in tables.items():
                counted = Observation(name)
                df.observe(counted, F.count(F.lit(1)).alias("rows")).write.parquet(f"{store.root}/{self.folders[name]}")
                self.rows[name] = counted.get["rows"]
        except BaseException:
            self._drop()
            raise

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/{self.folders[table]}")

    def publish(self) -> dict[str, int]:
        """Add one snapshot with the very files that were checked; nothing is copied or moved.

        Tables that another run has published meanwhile stay as they are, unless they are the same
        ones, which is a conflict and publishes nothing.
        """
        while True:
            version = max(self.store.versions(), default=0) + 1
            now = self.store.snapshot()
            taken = [n for n in self.folders if now.get(n) != self.before.get(n)]
            if taken:
                raise ConflictError(f"published by another run: {', '.join(sorted(taken))}")
            own = {n: {"folder": f, "rows": self.rows[n], "since": version} for n, f in self.folders.items()}
            if self.store.commits.create(f"{version:08d}.json", json.dumps(now | own, indent=1, sort_keys=True)):
                self.published = True
                return self.rows

    def _drop(self) -> None:
        for name, folder in self.folders.items():
            self.store.folder.delete(folder)
            self.store.folder.delete_if_empty(name)

    def __enter__(self) -> Staged:
        return self

    def __exit__(self, *error: object) -> None:
        if not self.published:
            self._drop()
