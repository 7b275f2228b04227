"""A Python data source for folders of pictures with JSON sidecars: the surface for own loaders.

    spark.dataSource.register(SidecarSource)
    spark.read.format("sidecars").option("pattern", "*.jpg").load("/data/shards")

Each subfolder is a shard and one partition; the folder itself is one if it has files. Rows are
``shard, stem, path, note``: the sidecar's text is null where there is none. The folder may lie on any
file system that Arrow knows by its URI (local, HDFS, object stores). Subclass it and override ``rows``
to read another layout.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Shard(InputPartition):
    def __init__(self, folder: str) -> None:
        self.folder = folder


class SidecarReader(DataSourceReader):
    def __init__(self, folder: str, pattern: str) -> None:
        self.folder, self.pattern = folder, pattern

    def listed(self, files: FileSystem, folder: str) -> list[FileInfo]:
        return sorted(files.get_file_info(FileSelector(folder)), key=lambda f: f.path)

    def pictures(self, entries: list[FileInfo]) -> list[FileInfo]:
        return [f for f in entries if f.type == FileType.File and fnmatch(f.base_name, self.pattern)]

    def partitions(self) -> list[Shard]:
        files, root = FileSystem.from_uri(self.folder)
        inside = self.listed(files, root)
        shards = [f.path for f in inside if f.type == FileType.Directory and self.pictures(self.listed(files, f.path))]
        return [Shard(p) for p in ([root] if self.pictures(inside) else []) + shards]

    def rows(self, files: FileSystem, folder: str) -> Iterator[tuple]:
        entries = self.listed(files, folder)
        notes = {f.path for f in entries if f.extension == "json"}
        for f in self.pictures(entries):
            stem = f.base_name.rsplit(".", 1)[0]
            note = f"{f.path.rsplit('.', 1)[0]}.json"
            text = None
            if note in notes:
                with files.open_input_stream(note) as stream:
                    text = stream.readall().decode("utf-8")
            yield folder.rstrip("/").rsplit("/", 1)[-1], stem, f.path, text

    def read(self, partition: Shard) -> Iterator[tuple]:
        return self.rows(FileSystem.from_uri(self.folder)[0], partition.folder)


class SidecarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sidecars"

    def schema(self) -> str:
        return "shard string, stem string, path string, note string"

    def reader(self, schema: object) -> SidecarReader:  # noqa: ARG002
        return SidecarReader(self.options["path"], self.options.get("pattern", "*.jpg"))
