"""A data source that writes one file for each name, from pieces in order, or one line for each; a write that fails leaves no file.

Rows are (name, piece), piece text or bytes, with the rows of a name next to each other and all in one task. As lines, the names of a task share
gzip files of bounded size, for names too many for files of their own: each file takes a block of the disk. A task streams pieces into files
of a folder of its own below ``_staging``; once all tasks are done the folders are moved into place, one move a task, and
after an error they are deleted. Files are reached through pyarrow's file systems, so the path may be of any store that these know.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructType


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI, or of a local path."""
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


class Lines:
    """A line for each name in gzip files of about ``most`` bytes; a file ends only between two names."""

    def __init__(self, store: fs.FileSystem, folder: str, extension: str, most: int) -> None:
        self.store, self.folder, self.extension, self.most = store, folder, extension, most
        self.files, self.raw, self.out = 0, None, None

    def begin(self, name: str) -> None:
        self.end()
        if self.out is not None and self.raw.tell() >= self.most:
            self.close()
        if self.out is None:
            self.raw = self.store.open_output_stream(f"{self.folder}/{self.files:05d}{self.extension}.gz", compression=None)
            self.out = gzip.GzipFile(fileobj=self.raw, mode="wb", compresslevel=1, mtime=0)
            self.files += 1

    def end(self) -> None:
        if self.out is not None:
            self.out.write(b"\n")

    def write(self, piece: bytes) -> None:
        if b"\n" in piece or b"\r" in piece:
            raise ValueError("Pieces of lines hold no line breaks")
        self.out.write(piece)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.raw.close()
        self.out = None


class Files:
    """A file for each name."""

    def __init__(self, store: fs.FileSystem, folder: str, extension: str) -> None:
        self.store, self.folder, self.extension = store, folder, extension
        self.out: BinaryIO | None = None
        self.done: set[str] = set()

    def begin(self, name: str) -> None:
        if name in self.done:
            raise ValueError(f"Pieces of {name!r} are not next to each other")
        self.end()
        self.done.add(name)
        self.out = self.store.open_output_stream(f"{self.folder}/{quote(name, safe='')}{self.extension}")

    def end(self) -> None:
        self.close()

    def write(self, piece: bytes) -> None:
        self.out.write(piece)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    part: str
    files: int


class PiecesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, extension: str, line_bytes: int) -> None:
        self.path, self.extension, self.line_bytes, self.run = path.rstrip("/"), extension, line_bytes, uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"part-{task.partitionId():05d}-{self.run[:8]}"
        store, folder = located(f"{self.staging}/{part}-{task.taskAttemptId()}")
        out = Lines(store, folder, self.extension, self.line_bytes) if self.line_bytes else Files(store, folder, self.extension)
        now, n = None, 0
        try:
            for batch in iterator:
                for name, piece in zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                    if not n or name != now:
                        if name is None:
                            raise ValueError("Pieces have no name")
                        if not n:
                            store.create_dir(folder, recursive=True)
                        out.begin(name)
                        now, n = name, n + 1
                    out.write(piece.encode() if isinstance(piece, str) else piece or b"")
            out.end()
            out.close()
        except BaseException:
            out.close()
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
            raise
        return Staged(folder if n else "", part, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, target = located(self.path)
        for m in messages:
            if isinstance(m, Staged) and m.folder:
                store.move(m.folder, f"{target}/{m.part}")
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, staging = located(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)


class PiecesSource(DataSource):
    """Options: path, extension (with its point), lineBytes (size of files of lines; 0, a file for each name)."""

    @classmethod
    def name(cls) -> str:
        return "pieces"

    def schema(self) -> str:
        return "name string, piece binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("pieces are only appended")
        if schema.names != ["name", "piece"] or not isinstance(schema["piece"].dataType, (StringType, BinaryType)):
            raise ValueError("pieces are rows (name, piece), with text or bytes")
        return PiecesWriter(self.options["path"], self.options.get("extension", ""), int(self.options.get("lineBytes", 0)))


def _write(placed: DataFrame, path: str, extension: str, line_bytes: int = 0) -> None:
    placed.sparkSession.dataSource.register(PiecesSource)
    placed.write.format("pieces").option("path", path).option("extension", extension).option("lineBytes", str(line_bytes)).mode("append").save()


def write_files(rows: DataFrame, path: str, name: str, order: list[str], piece: str, extension: str = "") -> None:
    """One file for each ``name`` below ``path``, its ``piece`` s in ``order``. Rows without a name are an error; a name's pieces are one task's work."""
    keyed = rows.select(F.col(name).cast("string").alias("name"), F.struct(*order).alias("_order"), F.col(piece).alias("piece"))
    _write(keyed.repartition("name").sortWithinPartitions("name", "_order").select("name", "piece"), path, extension)


def write_lines(rows: DataFrame, path: str, name: str, piece: str, extension: str = "", file_bytes: int = 64 << 20) -> None:
    """One line for each ``name`` in gzip files of about ``file_bytes`` below ``path``.

    Rows are dealt out by name and sorted already, as ``export.job_pieces`` gives them; pieces without line breaks.
    """
    _write(rows.select(F.col(name).cast("string").alias("name"), F.col(piece).alias("piece")), path, extension, file_bytes)
