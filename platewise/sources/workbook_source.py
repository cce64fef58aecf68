"""A Spark data source for folders of spreadsheet exports that reads files by ranges.

``spark.read.format("plate_workbooks").load(folder)`` gives sheet rows as ``SHEET_ROWS``. The
driver lists the files with their sizes and deals them into partitions of about
``partitionBytes``; a worker opens each file where it lies, reads the directory at its end
and then the entries one after another as streams. A file is never held as a whole, neither in
the JVM nor in the worker: besides one row and one batch of rows a worker keeps the text table of
a file, and a file whose text table is above ``maxStringBytes`` is told as unreadable, like a broken one.

Files are named ``*.xlsx`` in any letter case; names that begin with ``_`` or ``.`` are left
out, as Spark does. Workers need access to the store by pyarrow (local and mounted folders,
S3, Google Cloud Storage, HDFS with its library).
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as stores
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from platewise.schema import SHEET_ROWS
from platewise.sources import xlsx_decode

FORMAT = "plate_workbooks"
PARTITION_BYTES = 32 << 20
#: What opening a file costs, as bytes; spreads many tiny files.
OPEN_BYTES = 1 << 20
#: Bytes that are asked of a store at a time.
READ_BYTES = 1 << 20
#: Schemes of paths that workers can open, as pyarrow knows them.
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs"}


def open_store(folder: str) -> tuple[stores.FileSystem, str]:
    """The store of a folder given as Spark writes it, and the folder's path in it."""
    scheme, _, rest = folder.partition(":")
    if scheme == "file":
        return stores.LocalFileSystem(), "/" + rest.lstrip("/")
    return stores.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def packed(files: list[tuple[str, int]], most: int) -> list[list[tuple[str, int]]]:
    """Files (name, size) in partitions of about ``most`` bytes, the largest first; a larger
    file is a partition of its own."""
    parts: list[list[tuple[str, int]]] = []
    held = most + 1
    for name, size in sorted(files, key=lambda f: (-f[1], f[0])):
        if held + size + OPEN_BYTES > most:
            parts.append([])
            held = 0
        parts[-1].append((name, size))
        held += size + OPEN_BYTES
    return parts


class _Raw(io.RawIOBase):
    """An open file of a store as Python expects one."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.file.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        start = (0, self.file.tell(), self.file.size())[whence]
        if start + offset < 0:
            raise OSError("seek before the beginning")
        return self.file.seek(start + offset)

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]

    def __post_init__(self) -> None:
        super().__init__(None)


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.string_bytes = int(options.get("maxStringBytes", xlsx_decode.MAX_STRING_BYTES))

    def partitions(self) -> list[InputPartition]:
        store, base = open_store(self.folder)
        found = []
        for info in store.get_file_info(stores.FileSelector(base, recursive=True)):
            name = info.path[len(base) :].lstrip("/")
            hidden = any(part.startswith(("_", ".")) for part in name.split("/"))
            if info.is_file and not hidden and name.lower().endswith(".xlsx"):
                found.append((name, info.size))
        return [Files(part) for part in packed(found, self.partition_bytes)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, base = open_store(self.folder)

        def rows() -> Iterator[dict]:
            for name, _ in partition.files:
                path = f"{self.folder}/{name}"
                try:
                    file = store.open_input_file(f"{base}/{name}")
                except OSError as problem:
                    yield xlsx_decode.unreadable(path, problem)
                    continue
                with io.BufferedReader(_Raw(file), READ_BYTES) as buffered:
                    yield from xlsx_decode.sheet_rows(path, buffered, self.string_bytes)

        yield from xlsx_decode.in_batches(rows())


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return SHEET_ROWS

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def _by_value() -> None:
    """Ship the source with its tasks, so workers need no installed package."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_by_value()
