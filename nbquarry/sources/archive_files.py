"""The archive as named files, ``base/owner/repo/{sha8}_{name}.ipynb``: a data source that Spark reads and writes.

Reading packs files into partitions by bytes, so that many small notebooks make few tasks and a large one has its own;
conditions on owner and repository decide which folders are listed at all. Listing keeps names and sizes of what
matches, as Spark's own file sources do. Writing gives each row its file. A file appears under its name when it is
complete, so a task that runs twice leaves the same files; the commit adds up what the tasks report into ``_SUCCESS``.

Paths are local ones or URIs that ``pyarrow.fs`` opens; all machines must see them.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "notebook_archive"
SCHEMA = "owner string, repo string, archive_name string, path string, content binary"
# Bytes and files of a partition, and bytes that an open file counts for.
PARTITION_BYTES, PARTITION_FILES, OPEN_BYTES = 128 << 20, 10_000, 1 << 20
# Bytes of a batch that leaves a task.
BATCH_BYTES = 16 << 20
SUFFIX = ".ipynb"


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (pafs.LocalFileSystem(), base)


def pack(files: list[tuple[str, int]], most_bytes: int, most_files: int = PARTITION_FILES) -> list[list[str]]:
    """Paths in groups of at most ``most_bytes`` and ``most_files``; a larger file is a group of its own."""
    groups, size = [], 0
    for path, length in files:
        cost = length + OPEN_BYTES
        if not groups or size + cost > most_bytes or len(groups[-1]) >= most_files:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += cost
    return groups


@dataclass
class Files(InputPartition):
    paths: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, base: str, most_bytes: int):
        self.base, self.most_bytes = base, most_bytes
        # Allowed values by column, where conditions name them.
        self.allowed: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("owner",), ("repo",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                known = self.allowed.get(f.attribute[0])
                self.allowed[f.attribute[0]] = values if known is None else known & values
            else:
                yield f

    def _folders(self, fs: pafs.FileSystem, folder: str, column: str) -> list[str]:
        names = self.allowed.get(column)
        if names is not None:
            found = fs.get_file_info([f"{folder}/{n}" for n in sorted(n for n in names if n and "/" not in n)])
        else:
            found = fs.get_file_info(pafs.FileSelector(folder))
        return sorted(f.path for f in found if f.type == pafs.FileType.Directory and not f.base_name.startswith(("_", ".")))

    def partitions(self) -> list[Files]:
        fs, root = _open(self.base)
        files = []
        for owner in self._folders(fs, root.rstrip("/"), "owner"):
            for repo in self._folders(fs, owner, "repo"):
                listed = fs.get_file_info(pafs.FileSelector(repo))
                files += sorted((f.path, f.size) for f in listed if f.is_file and f.base_name.endswith(SUFFIX))
        return [Files(group) for group in pack(files, self.most_bytes)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.base)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            names = ["owner", "repo", "archive_name", "path"]
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(4)]
            return pa.record_batch([*columns, pa.array([r[4] for r in rows], pa.binary())], [*names, "content"])

        for path in partition.paths:
            with fs.open_input_stream(path) as file:
                content = file.read()
            rows.append((*path.split("/")[-3:], path, content))
            size += len(content)
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, base: str, overwrite: bool):
        self.base = base
        fs, root = _open(base)
        if overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir_contents(root)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.base)
        root, made, files, size = root.rstrip("/"), set(), 0, 0
        for batch in batches:
            for owner, repo, name, raw in zip(*(batch.column(c) for c in ("owner", "repo", "archive_name", "raw"))):
                parts = [owner.as_py(), repo.as_py(), name.as_py()]
                if any(not p or "/" in p or p in (".", "..") for p in parts):
                    raise ValueError(f"no file name: {parts}")
                folder = f"{root}/{parts[0]}/{parts[1]}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                unfinished = f"{folder}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(unfinished) as out:
                    out.write(raw.as_py().encode())
                    size += out.tell()
                fs.move(unfinished, f"{folder}/{parts[2]}")
                files += 1
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.base)
        fs.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        with fs.open_output_stream(f"{root.rstrip('/')}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.size for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are complete stay: they are what a repeated write would leave. Without ``_SUCCESS`` the archive is unfinished."""


class NotebookArchive(DataSource):
    """``spark.read.format("notebook_archive").load(base)``, and ``write`` with the columns owner, repo, archive_name, raw."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; it travels by value, so that workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(NotebookArchive)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
