"""Session and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_SPLIT_BYTES = 16 << 20
_MERGED_BYTES = 4 << 20
_SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open_scopes: list[list[str]] = []  # folders written since each scope was entered


def local_session(cores: int | str = "*", app: str = "trajecta", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster use the one that is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    On a cluster a machine-local folder would be lost with its executor, so we refuse.
    """
    context = spark.sparkContext
    shared = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if shared:
        return shared.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
    app = context.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="trajecta-")
    return _local_scratch[app]


@contextmanager
def _session_conf(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session inside the block; what it had before comes back."""
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialise(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Used where a small table is read by several branches, or where a value depends on how
    rows were laid out and must not change if an executor is lost.  It also gives the
    planner the true size of the table, so a join against it is broadcast only when it
    fits ``spark.sql.autoBroadcastJoinThreshold`` and is shuffled otherwise.  What was shuffled
    for the write is deleted with it, not when the driver's memory is next collected.
    ``options`` are those of the writer.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    with _session_conf(df.sparkSession, {_SHUFFLES_END: "true"}):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``df`` hash partitioned by ``keys`` into tasks of about ``most`` rows, more tasks for more rows.

    The planner merges partitions up to a size in compressed bytes, and a step that unfolds or sorts
    rows needs many times that in memory.  A number of tasks that is given is kept.  Rows are counted,
    so ``df`` should be a stored table.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(df.count() / most))
    return df.repartition(tasks, *keys)


@contextmanager
def small_tasks(spark: SparkSession, rows: int, most: int) -> Iterator[None]:
    """What runs inside the block scans small splits and shuffles ``rows`` rows into partitions of about
    ``most``, so that sums taken on both sides of a shuffle hold a bounded number of keys in a task.

    What the session had set comes back; a number of partitions is only raised.
    """
    partitions = "spark.sql.shuffle.partitions"
    wanted = {
        "spark.sql.files.maxPartitionBytes": f"{_SPLIT_BYTES}b",
        # Up to this many compressed bytes, partitions are merged again.
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{_MERGED_BYTES}b",
        partitions: str(max(int(spark.conf.get(partitions)), ceil(rows / most))),
    }
    with _session_conf(spark, wanted):
        yield


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's storage layer; one that is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialise`` writes inside the block when it ends, also by an error.

    For runs that leave their results elsewhere; a lazy DataFrame that outlives the block must
    not read such a folder.
    """
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            delete_folder(spark, path)
