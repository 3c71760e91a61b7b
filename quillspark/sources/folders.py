"""A data source of the files below a folder, whatever their names; Spark's own readers pass over names that begin with ``_`` or a dot.

    spark.dataSource.register(FolderSource)
    spark.read.format("folder").option("content", "true").load(root)    # (path, name, ext, size, content)

The driver lists folders level by level only until there are ``LEAST`` of them; each is a partition that an executor lists to its end, so a deep tree
is listed in parallel. Filters on ``path``, ``name`` and ``ext`` (equal, in a list, begins with, ends with, not equal) are taken over where Spark hands them
down (``spark.sql.python.filterPushdown.enabled``), so files that they leave out are never opened.

Edge cases: hidden files and system folders are left out; an empty or missing folder gives no rows; a name without a dot has an empty
extension; with ``content`` the bytes are read, else the column is null.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, Not, StringEndsWith, StringStartsWith

SCHEMA = "path string, name string, ext string, size bigint, content binary"
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
LEAST = 64  # folders that are partitions of their own, where there are so many
LEVELS = 8  # that the driver lists at most
BATCH_BYTES = 8 << 20
#: Folders of systems.
SYSTEM_FOLDERS = ("__MACOSX",)
FIELDS = ("path", "name", "ext")


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _shown(name: str) -> bool:
    return not name.startswith(".") and name not in SYSTEM_FOLDERS


class Folder(InputPartition):
    """A folder below the root, and whether all below it belongs to the partition or only its own files."""

    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str, content: bool):
        self.root, self.content, self.tests = root, content, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take over what concerns a file's name; the rest goes back to Spark."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, (EqualTo, In, StringStartsWith, StringEndsWith)) and inner.attribute[0] in FIELDS and len(inner.attribute) == 1:
                self.tests.append((type(inner).__name__, inner.attribute[0], inner.value if not isinstance(inner, In) else tuple(inner.value), isinstance(f, Not)))
            else:
                yield f

    def _passes(self, row: dict) -> bool:
        for kind, column, value, negated in self.tests:
            own = row[column]
            hit = {"EqualTo": lambda: own == value, "In": lambda: own in value, "StringStartsWith": lambda: own.startswith(value), "StringEndsWith": lambda: own.endswith(value)}[kind]()
            if hit == negated:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        system, base = _open(self.root)
        flat, open_ = [], [base]
        for _ in range(LEVELS):
            if not open_ or len(open_) >= LEAST:
                break
            flat += open_  # their own files; what is below them are partitions of the next level
            open_ = [f.path for folder in open_ for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.Directory and _shown(f.base_name)]
        return [Folder(p, False) for p in flat] + [Folder(p, True) for p in open_] or [Folder(base, False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        system, base = _open(self.root)
        rows, size, open_ = [], 0, [partition.path]
        while open_:
            for f in system.get_file_info(fs.FileSelector(open_.pop(), allow_not_found=True)):
                if not _shown(f.base_name):
                    continue
                if f.type == fs.FileType.Directory:
                    open_ += [f.path] if partition.deep else []
                    continue
                row = {"path": f.path[len(base.rstrip("/")) + 1 :], "name": f.base_name, "ext": f.extension.lower(), "size": f.size, "content": None}
                if not self._passes(row):
                    continue
                if self.content:
                    with system.open_input_file(f.path) as file:
                        row["content"] = file.read()
                    size += len(row["content"])
                rows.append(row)
                if size >= BATCH_BYTES or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("content", "false").lower() == "true")


def load(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """The files below a folder, with filters on their names handed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").option("content", str(content).lower()).load(root)
