"""The dataset adapters (S12-S14) as a data source: ``spark.read.format("viewgrade_images")``.

Options: ``path`` (a local path or a URI that Arrow's file systems know: file, hdfs, s3, gs) and ``adapter`` (a name of
``FOLDERS``).  A partition is a folder right below the path (or the path itself, for files there), and its task lists it.
Filters on ``folder`` by = and IN, and on ``extension``, reach the reader: folders that they rule out, or the adapter
excludes, are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# fixed values: folders of the multi-drone layout that hold no reference images
NO_REFERENCE = ("loss", "noise", "point_clouds", "Annotations", "original_json", "original_xml", "train", "test", ".git", "distorted")
#: Excluded folder names by adapter; ``register_layout`` adds to them.
FOLDERS: dict[str, tuple[str, ...]] = {"multi_drone": NO_REFERENCE, "generic": ()}
EXTENSIONS = ("jpg", "jpeg", "png")
SCHEMA = pa.schema([("path", pa.string()), ("folder", pa.string()), ("name", pa.string()), ("extension", pa.string()), ("bytes", pa.int64())])


def register_layout(name: str, excluded: tuple[str, ...]) -> None:
    FOLDERS[name] = tuple(excluded)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


@dataclass
class Folder(InputPartition):
    """A folder below the root; the empty name stands for the files in the root itself."""

    name: str


class ImageReader(DataSourceReader):
    def __init__(self, path: str, excluded: tuple[str, ...]):
        self.path, self.excluded = path.rstrip("/"), frozenset(excluded)
        self.folders: frozenset[str] | None = None
        self.extensions = frozenset(EXTENSIONS)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = frozenset([f.value]) if isinstance(f, EqualTo) else frozenset(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("folder",):
                self.folders = values if self.folders is None else self.folders & values
            elif values is not None and f.attribute == ("extension",):
                self.extensions &= values
            else:
                yield f

    def partitions(self) -> list[Folder]:
        files, root = _opened(self.path)
        found = files.get_file_info(fs.FileSelector(root))
        names = sorted(x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name not in self.excluded)
        if any(x.type == fs.FileType.File for x in found):
            names = ["", *names]
        return [Folder(n) for n in names if self.folders is None or n in self.folders]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, root = _opened(self.path)
        todo, rows = [f"{root}/{partition.name}".rstrip("/")], []
        while todo:
            for x in sorted(files.get_file_info(fs.FileSelector(todo.pop())), key=lambda x: x.path):
                if x.type == fs.FileType.Directory:
                    if partition.name and x.base_name not in self.excluded:
                        todo.append(x.path)
                elif (ending := x.extension.lower()) in self.extensions:
                    rows.append({"path": x.path, "folder": partition.name, "name": x.base_name, "extension": ending, "bytes": x.size})
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


class ImageListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "viewgrade_images"

    def schema(self) -> str:
        return "path string, folder string, name string, extension string, bytes long"

    def reader(self, schema) -> ImageReader:
        adapter = self.options.get("adapter", "generic")
        if adapter not in FOLDERS and "excluded" not in self.options:
            raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(sorted(FOLDERS))}")
        # layouts that this session registered come as an option, as the reader is made in another process
        excluded = self.options["excluded"].split("/") if "excluded" in self.options else FOLDERS[adapter]
        return ImageReader(self.options["path"], tuple(x for x in excluded if x))


def reference_images(spark: SparkSession, path: str, adapter: str = "generic") -> DataFrame:
    """Path, folder, name, extension and bytes of the reference images that an adapter finds."""
    if adapter not in FOLDERS:
        raise ValueError(f"unknown adapter {adapter!r}; known: {', '.join(sorted(FOLDERS))}")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ImageListing)
    return spark.read.format("viewgrade_images").option("path", path).option("adapter", adapter).option("excluded", "/".join(FOLDERS[adapter])).load()
