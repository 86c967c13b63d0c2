"""Spark data source ``dense_binary``: matrices in files of big-endian 32-bit floats, row after row.

    spark.dataSource.register(DenseBinary)
    spark.read.format("dense_binary").option("columns", 64).load(path)      # (path, row, features)
    df.write.format("dense_binary").option("columns", 64).mode("append").save(path)

A file is read by many tasks, each of which takes rows of about ``splitBytes`` (64 MB) of it. A file that is no whole number of
rows is an error before anything is read. Names that begin with a dot or an underscore are not data, as everywhere in Spark.
Every writing task fills a file of its own out of sight; the commit gives all of them their names, and an aborted job
gives none; a task that is killed late may leave a hidden file, which is no data. Null or short rows cannot be written and are errors. An empty folder has no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH = 1 << 22  # bytes a batch of rows


@dataclass
class Span(InputPartition):
    path: str
    first: int
    rows: int


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri("file://" + path if path.startswith("/") else path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class DenseBinary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dense_binary"

    def schema(self) -> str:
        return "path string, row long, features array<double>"

    def _columns(self) -> int:
        columns = int(self.options.get("columns", 0))
        if columns < 1:
            raise ValueError("set the option columns to the length of a row")
        return columns

    def reader(self, schema) -> DenseReader:
        return DenseReader(self.options["path"], self._columns(), int(self.options.get("splitBytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> DenseWriter:
        if "features" not in schema.names:
            raise ValueError("rows to write have a column features")
        return DenseWriter(self.options["path"], self._columns(), overwrite)


class DenseReader(DataSourceReader):
    def __init__(self, path: str, columns: int, split: int):
        self.path, self.width, self.per_split = path, 4 * columns, max(1, split // (4 * columns))

    def partitions(self) -> list[Span]:
        system, path = located(self.path)
        top = system.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [top] if top.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"]
        spans = []
        for f in sorted(files, key=lambda f: f.path):
            if f.size % self.width:
                raise ValueError(f"{f.path}: {f.size} bytes are no whole rows of {self.width}")
            rows = f.size // self.width
            spans += [Span(f.path, at, min(self.per_split, rows - at)) for at in range(0, rows, self.per_split)]
        return spans or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.rows:
            return
        system, _ = located(self.path)
        step = max(1, BATCH // self.width)
        with system.open_input_file(span.path) as f:
            f.seek(span.first * self.width)
            for at in range(span.first, span.first + span.rows, step):
                n = min(step, span.first + span.rows - at)
                content = f.read(n * self.width)
                if len(content) < n * self.width:
                    raise ValueError(f"{span.path}: ends inside row {at + len(content) // self.width}")
                cells = pa.array(np.frombuffer(content, ">f4").astype(float))
                offsets = pa.array(np.arange(0, n * self.width // 4 + 1, self.width // 4, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([span.path] * n), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(offsets, cells)], names=["path", "row", "features"])


class DenseWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: int, overwrite: bool):
        self.path, self.columns, self.overwrite, self.job = path, columns, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, path = located(self.path)
        # attempts of one task have names of their own, so that one cannot write into another's file
        name = f"part-{TaskContext.get().partitionId():05d}-{self.job}.bin"
        hidden = f"{path}/_{self.job}/{name}.{TaskContext.get().taskAttemptId()}"
        system.create_dir(f"{path}/_{self.job}", recursive=True)
        with system.open_output_stream(hidden) as out:
            for b in batches:
                rows = b.column("features")
                if rows.null_count or rows.flatten().null_count or (rows.value_lengths().to_numpy() != self.columns).any():
                    raise ValueError(f"not all rows have {self.columns} numbers")
                out.write(rows.flatten().to_numpy(zero_copy_only=False).astype(">f4").tobytes())
        return Written(hidden, name)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        old = [f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.is_file] if self.overwrite else []
        for m in filter(None, messages):
            system.move(m.hidden, f"{path}/{m.name}")
        for f in old:
            system.delete_file(f)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Also the end of a commit: the hidden folder goes."""
        system, path = located(self.path)
        if system.get_file_info(f"{path}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/_{self.job}")
