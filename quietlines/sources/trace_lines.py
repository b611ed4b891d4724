"""The `trace_lines` data source: lines of session files with their numbers.

Small files share partitions; a file is read line by line with replacement decoding and
universal line ends, so its memory is one batch of lines. A file that cannot be read
gives one row with line number 0 and its `error`. The built-in text source gives no
numbers, strips byte order marks and drops some names.

Batch: spark.read.format("trace_lines").option("files", json).load() or `read_lines`.
Stream: spark.readStream.format("trace_lines").option("path", folder).load().
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quietlines.sources.discovery import Listed, list_root

SCHEMA = "relative_path string, line_number bigint, raw string, error string"
#: Bytes of files that one partition reads, unless one file alone is larger.
PER_PARTITION = 128 << 20


class FilePartition(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


def grouped(files: list[tuple[str, str]], per_partition: int = PER_PARTITION) -> list[FilePartition]:
    """Files in order, as many to a partition as its size allows."""
    groups: list[list[tuple[str, str]]] = []
    held = per_partition + 1
    for path, name in files:
        try:
            size = os.path.getsize(path)
        except OSError:
            size = 0
        if held + size > per_partition:
            groups.append([])
            held = 0
        groups[-1].append((path, name))
        held += size + (1 << 14)  # opening a file costs too
    return [FilePartition(g) for g in groups]


def lines_of(path: str) -> Iterator[tuple[int, str]]:
    with open(path, encoding="utf-8", errors="replace") as f:
        for number, line in enumerate(f, 1):
            yield number, line.rstrip("\r\n")


def rows_of(partition: FilePartition) -> Iterator[tuple]:
    for path, name in partition.files:
        try:
            for number, text in lines_of(path):
                yield (name, number, text, None)
        except OSError as error:
            yield (name, 0, None, error.strerror or type(error).__name__)


class TraceLinesReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return grouped(self.files)

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return rows_of(partition)


class TraceLinesStream(DataSourceStreamReader):
    """New files of a folder, each delivered once and read on the executors; the offset is the list of names seen."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        return {"seen": sorted(f.relative_path for f in list_root(self.root))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        wanted = set(end["seen"]) - set(start["seen"])
        return grouped([(f.path, f.relative_path) for f in list_root(self.root) if f.relative_path in wanted])

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return rows_of(partition)

    def commit(self, end: dict) -> None:
        pass


class TraceLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "files" in self.options:
            return TraceLinesReader([tuple(f) for f in json.loads(self.options["files"])])
        return TraceLinesReader([(f.path, f.relative_path) for f in list_root(self.options["path"])])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TraceLinesStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceLines)


def read_lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Lines of the files of a discovery table; the driver handles names only."""
    register(spark)
    names = [(r["path"], r["relative_path"]) for r in files.select("path", "relative_path").collect()]
    return spark.read.format("trace_lines").option("files", json.dumps(names)).load()
