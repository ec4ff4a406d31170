"""One ordered text file from many tasks, as a data source to write to.

Each task writes its pages, in order, as one part beside the target, and tells how many they are. When all have ended, the
driver puts head, parts and tail together, from stream to stream in pieces of a few MB, under another name, and gives it the
target's name at the end. So no process holds more than a piece; a task that is lost or run twice leaves a part that nobody
takes, and a reader sees the whole file or none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "corpusloom_report"
PIECE = 4 << 20


@dataclass(frozen=True)
class Frame:
    """What stands around the pages: before all, before the first, between two, after the last, and after all."""

    head: str = ""
    first: str = ""
    between: str = ""
    last: str = ""
    tail: str = ""


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str
    pages: int


class ReportFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("a report is written from one column of text")
        return ReportWriter(self.options)


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        self.frame = Frame(**{k: options.get(k, "") for k in ("head", "first", "between", "last", "tail")})

    def _files(self, uri: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        context, pages, out = TaskContext.get(), 0, None
        files, folder = self._files(self.parts)
        path = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        between = self.frame.between.encode()
        for batch in iterator:
            for text in batch.column(0):
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = files.open_output_stream(path)
                if pages:
                    out.write(between)
                out.write(text.as_buffer() if text.is_valid else b"")
                pages += 1
        if out is not None:
            out.close()
        return Part(context.partitionId(), path, pages)

    def commit(self, messages: list[Part | None]) -> None:
        files, target = self._files(self.path)
        folder, hidden = self._files(self.parts)[1], f"{target}.{uuid.uuid4().hex}"
        files.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(hidden) as out:
            out.write(self.frame.head.encode())
            full = sorted((m for m in messages if m is not None and m.pages), key=lambda m: m.number)
            for i, part in enumerate(full):
                out.write((self.frame.between if i else self.frame.first).encode())
                with files.open_input_stream(part.path) as own:
                    while piece := own.read(PIECE):
                        out.write(piece)
            if full:
                out.write(self.frame.last.encode())
            out.write(self.frame.tail.encode())
        files.move(hidden, target)
        self._clear(files, folder)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*self._files(self.parts))

    @staticmethod
    def _clear(files, folder: str) -> None:
        from pyarrow.fs import FileType

        if files.get_file_info(folder).type == FileType.Directory:
            files.delete_dir(folder)


def write_report(pages: DataFrame, path: str, frame: Frame) -> str:
    """Writes the one column of pages, in the order of its partitions and of their rows, as the file at path."""
    pages.sparkSession.dataSource.register(ReportFile)
    options = {k: v for k, v in vars(frame).items() if v}
    pages.write.format(FORMAT).mode("overwrite").options(path=path, **options).save()
    return path
