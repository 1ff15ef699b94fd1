"""Arrow IPC files as a Spark source and sink: a task reads some record batches of a file, a task writes a file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from .readers import _signed

#: Bytes of a file that a task reads, about.
SPLIT = 64 << 20
_WAITING = "_waiting"


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, any that Arrow knows, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files below a folder, by path; names that begin with a dot or an underscore are not data."""
    system, root = _place(path)
    if system.get_file_info(root).type == pafs.FileType.File:
        return [(root, system.get_file_info(root).size)]
    found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    inner = lambda x: x.path[len(root.rstrip("/")) + 1 :].split("/")
    return sorted((x.path, x.size) for x in found if x.type == pafs.FileType.File and not any(p.startswith((".", "_")) for p in inner(x)))


@dataclass
class _Share(InputPartition):
    """The ``nth`` of ``of`` shares of a file's record batches."""

    file: str
    number: int
    nth: int
    of: int

    def __post_init__(self) -> None:
        super().__init__(self)


class _Reader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split: int):
        self.path, self.columns, self.split = path, columns, split

    def partitions(self) -> list[_Share]:
        """Shares by the files' sizes: no footer is read here."""
        out = []
        for number, (file, size) in enumerate(_files(self.path)):
            n = max(1, -(-size // self.split))
            out += [_Share(file, number, i, n) for i in range(n)]
        return out

    def read(self, partition: _Share) -> Iterator[pa.RecordBatch]:
        system, _ = _place(self.path)
        with system.open_input_file(partition.file) as source:
            with ipc.open_file(source) as reader:
                schema, n = reader.schema, reader.num_record_batches
            missing = [c for c in self.columns if c not in schema.names]
            if missing:
                raise ValueError(f"{partition.file} has no columns {missing}.")
            with ipc.open_file(source, options=ipc.IpcReadOptions(included_fields=sorted(schema.get_field_index(c) for c in self.columns))) as reader:
                for i in range(n * partition.nth // partition.of, n * (partition.nth + 1) // partition.of):
                    batch = reader.get_batch(i).select(self.columns)
                    yield batch.cast(_signed(batch.schema))


@dataclass
class _Written(WriterCommitMessage):
    waiting: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    """A task writes to a file that waits; the commit moves the files of the tasks that count to their place, and removes those that other attempts left."""

    def __init__(self, path: str, overwrite: bool, schema: StructType):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        self.schema = to_arrow_schema(schema)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, root = _place(self.path)
        name, rows = f"{root}/{_WAITING}/{self.job}/{uuid.uuid4().hex}.arrow", 0
        first = next(iterator, None)
        while first is not None and first.num_rows == 0:
            first = next(iterator, None)
        if first is None:
            return _Written(None, 0)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        try:
            with system.open_output_stream(name) as out, ipc.new_file(out, first.schema) as writer:
                while first is not None:
                    writer.write_batch(first)
                    rows += first.num_rows
                    first = next(iterator, None)
        except BaseException:
            system.delete_file(name)
            raise
        return _Written(name, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _place(self.path)
        old = [f for f, _ in _files(self.path)] if self.overwrite else []
        kept = [m.waiting for m in messages if m is not None and m.waiting]
        system.create_dir(root, recursive=True)
        for i, name in enumerate(kept):
            system.move(name, f"{root}/part-{i:06d}-{self.job}.arrow")
        for name in old:
            system.delete_file(name)
        if not kept and not (_files(self.path)):
            # a table without rows keeps its columns
            with system.open_output_stream(f"{root}/part-000000-{self.job}.arrow") as out, ipc.new_file(out, self.schema):
                pass
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, root = _place(self.path)
        waiting = f"{root}/{_WAITING}"
        if system.get_file_info(f"{waiting}/{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{waiting}/{self.job}")
        if system.get_file_info(waiting).type == pafs.FileType.Directory and not system.get_file_info(pafs.FileSelector(waiting)):
            system.delete_dir(waiting)


class ArrowFiles(DataSource):
    """``format("arrow_files")``: options ``path``, ``columns`` (a comma between names; all without it) and ``split`` (bytes a task)."""

    @classmethod
    def name(cls) -> str:
        return "arrow_files"

    def _file_schema(self) -> pa.Schema:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"There are no Arrow files at {self.options['path']}.")
        system, _ = _place(self.options["path"])
        with system.open_input_file(files[0][0]) as source, ipc.open_file(source) as reader:
            return reader.schema

    def schema(self) -> StructType:
        found = self._file_schema()
        names = self.options["columns"].split(",") if self.options.get("columns") else found.names
        return from_arrow_schema(_signed(pa.schema([found.field(c) for c in names])))

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema.names, int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite, schema)


def scan_arrow(spark: SparkSession, path: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Arrow IPC files at a path that all machines reach through Arrow's file systems, a file or a folder.

    Each task takes a share of a file's record batches, by the file's size, and reads of these only the ``columns``; so a file of any size is read by many
    tasks, and neither a whole file nor a footer passes the driver, which reads the first file's schema. All files have that file's columns. Unsigned types are the next wider signed ones. A path without files raises.
    """
    spark.dataSource.register(ArrowFiles)
    reader = spark.read.format("arrow_files").option("path", path).option("split", split)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def write_arrow(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """``df`` as a folder of Arrow IPC files, one a task that has rows, written where the task runs and moved to their place when all tasks have ended.

    A task that fails leaves no file, and what a lost executor left is removed with the job. Without rows one file keeps the columns. Overwriting removes the former files last.
    """
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format("arrow_files").mode("overwrite" if overwrite else "append").option("path", path).save()
