"""format("ebook"): a Python data source over a folder or a file, local or in a store that Arrow opens by URI (s3, gs, hdfs, file)."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codexa.sources.model import Options
from codexa.sources.reader import PARSED, row

#: Bytes of files that one task reads, about; a larger file is a task of its own.
PARTITION_BYTES = 64_000_000


class EbookPartition(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class EbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path", "").strip()
        self.options = Options(int(options.get("maxResourceSize", 0)), int(options.get("maxRecordSize", 0)), int(options.get("maxExthRecords", 0)), options.get("kf8Fallback", "true").lower() == "true", options.get("content", "true").lower() == "true")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[EbookPartition]:
        store, path = self._store()
        top = store.get_file_info(path)
        found = [top] if top.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        groups, held = [], PARTITION_BYTES
        for info in sorted((x for x in found if x.type == fs.FileType.File), key=lambda x: x.path):
            if held + info.size > PARTITION_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(info.path)
            held += info.size
        return [EbookPartition(g) for g in groups]

    def read(self, partition: EbookPartition) -> Iterator[tuple]:
        store, _ = self._store()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                found = row(path, f.read(), self.options)
            yield tuple(self._value(v) for v in found.values())

    def _value(self, v):
        if isinstance(v, list) and v and isinstance(v[0], dict):
            return [tuple(x.values()) for x in v]
        return v


class Ebook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ebook"

    def schema(self) -> str:
        return PARSED

    def reader(self, schema) -> EbookReader:
        return EbookReader(dict(self.options))


def register(spark) -> None:
    spark.dataSource.register(Ebook)
