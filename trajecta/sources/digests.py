"""SHA-256 of files of any size, as a data source whose readers stream them.

A file is read in ranges and hashed in constant memory, one file in one task after another; small
files share a task.  The columns are ``path string, octets bigint, sha256 string``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "trajecta_digests"
SCHEMA = "path string, octets bigint, sha256 string"
RANGE_BYTES = 8 << 20
TASK_BYTES = 256 << 20  # files are put into one task up to this size
# Storage that can be read without the JVM, and the name it goes by there.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def can_stream(uri: str) -> bool:
    return urlsplit(uri).scheme in STREAMED


def open_stream(uri: str) -> pa.NativeFile:
    parts = urlsplit(uri)
    scheme = STREAMED[parts.scheme]
    if scheme == "file":
        return pyarrow.fs.LocalFileSystem().open_input_stream(unquote(parts.path), buffer_size=0)
    system, path = pyarrow.fs.FileSystem.from_uri(parts._replace(scheme=scheme).geturl())
    return system.open_input_stream(path, buffer_size=0)


def digest(*uris: str) -> tuple[int, str]:
    """Bytes read and their SHA-256, of one file or of the parts of one in their order."""
    found, size = hashlib.sha256(), 0
    for uri in uris:
        with open_stream(uri) as stream:
            while block := stream.read(RANGE_BYTES):
                found.update(block)
                size += len(block)
    return size, found.hexdigest()


@dataclass
class Files(InputPartition):
    files: dict[str, list[str]]  # the parts of each


def shares(files: list[tuple[str, int]], most: int = TASK_BYTES) -> list[list[str]]:
    """Files dealt into tasks: large ones alone, others together up to ``most`` bytes."""
    out: list[list[str]] = []
    held = most
    for uri, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if held + size > most:
            out.append([])
            held = 0
        out[-1].append(uri)
        held += size
    return out


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], parts: dict[str, list[str]]) -> None:
        self.files, self.parts = files, parts

    def partitions(self) -> list[Files]:
        dealt = [Files({uri: self.parts.get(uri, [uri]) for uri in uris}) for uris in shares(self.files)]
        return dealt or [Files({})]

    def read(self, partition: Files) -> Iterator[tuple[str, int, str]]:
        for uri, parts in partition.files.items():
            yield (uri, *digest(*parts))


class FileDigests(DataSource):
    """``files`` is a JSON list of URIs and sizes, as the storage layer lists them; ``parts`` names
    the parts of those that lie in several."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> _Reader:
        files = [(uri, size) for uri, size in json.loads(self.options["files"])]
        return _Reader(files, json.loads(self.options["parts"]))


def read_digests(spark: SparkSession, files: list[tuple[str, int]],
                 parts: Mapping[str, list[str]] | None = None) -> DataFrame:
    """``path, octets, sha256`` of files given by URI and size, some of them in ``parts``."""
    spark.dataSource.register(FileDigests)
    given = spark.read.format(FORMAT).option("files", json.dumps(files))
    return given.option("parts", json.dumps(dict(parts or {}))).load()
