"""`spark.read.format("windrow_files")`: a directory tree as a data source, hidden names included."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from windrow.sources.files import decode, list_files


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = options["path"].split(",")
        self.extensions = options.get("extensions", "*").split(",")
        self.encoding = options.get("encoding", "utf-8")
        self.per_task = int(options.get("files_per_task", 64))

    def partitions(self) -> list[InputPartition]:
        files, _ = list_files(self.roots, self.extensions)
        return [InputPartition(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            with open(path, "rb") as f:
                text, problem = decode(f.read(), self.encoding)
            yield path, text, problem


class DirectorySource(DataSource):
    """Options: path (comma-separated roots), extensions, encoding, files_per_task. Columns: path, text, problem."""

    @classmethod
    def name(cls) -> str:
        return "windrow_files"

    def schema(self) -> str:
        return "path string, text string, problem string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DirectorySource)
