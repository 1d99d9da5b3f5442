"""Every file of a tree, hidden names included, and the lines of listed files with their offsets.

Spark's own listing passes over names that begin with a dot or an underscore and stops at the
first file it may not read. This source lists folders inside tasks, and what cannot be read
becomes a row with its reason.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders opened before the tasks are made; rows of a batch; bytes of a file one task reads at a time.
FOLDERS, BATCH_ROWS, SPLIT_BYTES = 256, 4_096, 64 << 20
SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()),
                       T.StructField("reason", T.StringType())])
COLUMNS = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.float64()), ("reason", pa.string())])

Row = tuple[str, int | None, float | None, str | None]
Lister = Callable[[str], tuple[list[Row], list[str]]]


def local_folder(folder: str) -> tuple[list[Row], list[str]]:
    """(files, folders) of one folder. Links to folders are not followed, links to files are files."""
    files, folders = [], []
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError as error:
        return [(folder, None, None, str(error))], []
    for entry in found:
        try:
            if entry.is_dir(follow_symlinks=False):
                folders.append(entry.path)
            elif entry.is_file():
                info = entry.stat()
                files.append((entry.path, info.st_size, info.st_mtime, None))
        except OSError as error:
            files.append((entry.path, None, None, str(error)))
    return files, folders


def remote_folder(folder: str) -> tuple[list[Row], list[str]]:
    system, inside = pafs.FileSystem.from_uri(folder)
    head = folder[: len(folder) - len(inside)] if folder.endswith(inside) else ""
    try:
        found = system.get_file_info(pafs.FileSelector(inside))
    except OSError as error:
        return [(folder, None, None, str(error))], []
    files = [(head + i.path, i.size, i.mtime_ns / 1e9 if i.mtime_ns else None, None) for i in found if i.type == pafs.FileType.File]
    return files, [head + i.path for i in found if i.type == pafs.FileType.Directory]


def lister(root: str) -> Lister:
    return remote_folder if "://" in root else local_folder


def below(folder: str, skip: frozenset[str], listed: Lister) -> Iterator[Row]:
    """All files under a folder, one folder in memory at a time beside the names still to open."""
    waiting = [folder]
    while waiting:
        files, folders = listed(waiting.pop())
        yield from files
        waiting += [f for f in folders if os.path.basename(f) not in skip]


class Part(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: frozenset[str], folders: int):
        self.root, self.skip, self.folders = root, skip, folders

    def partitions(self) -> list[Part]:
        """Upper folders are opened level by level until there are enough to share out; each is listed again by its task."""
        listed, opened, level = lister(self.root), [], [self.root]
        while level and len(opened) + len(level) < self.folders:
            opened += level
            level = [f for folder in level for f in listed(folder)[1] if os.path.basename(f) not in self.skip]
        return [Part(f, False) for f in opened] + [Part(f, True) for f in level]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        listed, rows = lister(self.root), []
        for row in below(part.folder, self.skip, listed) if part.deep else listed(part.folder)[0]:
            rows.append(row)
            if len(rows) == BATCH_ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def batch(rows: list[Row]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), COLUMNS)], schema=COLUMNS)


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("skip", "a;b").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> TreeReader:
        skip = frozenset(s for s in self.options.get("skip", "").split(";") if s)
        return TreeReader(plain(self.options["path"]), skip, int(self.options.get("folders", FOLDERS)))


def plain(root: str) -> str:
    """A local address without its scheme, as the manifest names files."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return root.rstrip("/") or "/"


def tree(spark: SparkSession, root: str, skip: tuple[str, ...] = (), folders: int = FOLDERS) -> DataFrame:
    """(path, size, mtime, reason): every file under ``root``; ``reason`` says why one could not be looked at.

    Folders named in ``skip`` are left out at any depth. A folder that cannot be opened is one row.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format("file_tree").option("skip", ";".join(skip)).option("folders", folders).load(root)


# --- lines -----------------------------------------------------------------------------------

def opened(path: str):
    if "://" in path:
        system, inside = pafs.FileSystem.from_uri(path)
        return io.BufferedReader(system.open_input_file(inside))
    return open(path, "rb")


def lines_between(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin at ``start`` or later and before ``stop``."""
    file.seek(max(0, start - 1))
    if start:
        file.readline()
    at = file.tell()
    while at < stop and (line := file.readline()):
        yield at, line.removesuffix(b"\n").removesuffix(b"\r")
        at += len(line)


def read_lines(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, offset, line, reason) of files (path, size): a long file is many tasks' work, no file is one row.

    Offsets are bytes, so they order the lines of a file. Bytes that are no UTF-8 become
    replacement characters. A file that cannot be read gives one row with the reason.
    """
    parts = files.filter(F.col("size") > 0).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    spread = parts.repartition("path", "start")
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("line", pa.string()), ("reason", pa.string())])

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        rows = []
        for found in batches:
            for path, start in zip(found["path"].to_pylist(), found["start"].to_pylist()):
                try:
                    with opened(path) as file:
                        for offset, line in lines_between(file, start, start + split_bytes):
                            rows.append((path, offset, line.decode("utf-8", "replace"), None))
                            if len(rows) == BATCH_ROWS:
                                yield packed(rows)
                                rows = []
                except OSError as error:
                    rows.append((path, start, None, str(error)))
        if rows:
            yield packed(rows)

    return spread.mapInArrow(run, "path string, offset long, line string, reason string")


def contents(files: DataFrame) -> DataFrame:
    """(path, content) of files (path); those that cannot be read are left out, ``tree`` and ``read_lines`` say why."""
    def run(batches):
        for found in batches:
            for path in found["path"].to_pylist():
                try:
                    with opened(path) as file:
                        whole = file.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([whole], pa.binary())], names=["path", "content"])

    return files.select("path").repartition("path").mapInArrow(run, "path string, content binary")
