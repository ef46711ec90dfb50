"""Call traces in compressed archives of CSV files, as a Spark data source.

``spark.read.format("call_archives").load(path)`` after ``register``: one partition an archive
(``.tar.gz`` or ``.tgz`` files of a folder, or one file), whose members are streamed, so neither
an archive nor a member is held whole.  Lines have 8 columns (traceid, timestamp, rpcid, um,
rpctype, dm, interface, rt) or 9 (a number before them); a line with fewer, and the header,
is left out, and so is one whose time is no number.  An empty time is 0.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "trace string, rpcid string, um string, rpctype string, dm string, rt double, archive string, member string, line bigint"
ARROW = pa.schema([(c.split(" ")[0], {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64()}[c.split(" ")[1]]) for c in SCHEMA.split(", ")])
ROWS = 10_000


def parsed(text: str) -> tuple | None:
    """trace, rpcid, um, rpctype, dm, rt of a line."""
    line = text.strip()
    parts = line.split(",")
    if not line or "traceid" in line or len(parts) < 8:
        return None
    at = 1 if len(parts) >= 9 else 0
    try:
        rt = float(parts[at + 7]) if parts[at + 7] else 0.0
    except ValueError:
        return None
    return parts[at], parts[at + 2], parts[at + 3], parts[at + 4], parts[at + 5], rt


class Archive(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Archive]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        found = sorted(f.path for f in files if f.is_file and (f.path.endswith((".tar.gz", ".tgz")) or info.is_file))
        return [Archive(scheme + f) for f in found]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_stream(path, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|gz") as tar:
            for member in tar:
                if not member.isfile() or not member.name.endswith(".csv"):
                    continue
                rows: list[tuple] = []
                for number, line in enumerate(tar.extractfile(member)):
                    row = parsed(line.decode("utf-8", errors="ignore"))
                    if row is not None:
                        rows.append((*row, partition.path, member.name, number))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class CallArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "call_archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        path = self.options.get("path") or ""
        return ArchiveReader(path if "://" in path else f"file://{path.removeprefix('file:')}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CallArchives)


def read_calls(spark: SparkSession, path: str) -> DataFrame:
    """The calls of all archives of a folder."""
    register(spark)
    return spark.read.format("call_archives").load(path)
