"""Scans of files, bytes and values."""

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..subjects import BATCH, ROW


def _mode(lenient: bool) -> str:
    return "DROPMALFORMED" if lenient else "FAILFAST"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, quote: str = '"', null_value: str | None = None, lenient: bool = False) -> DataFrame:
    """A CSV file or folder; the schema is inferred if none is given. Broken rows raise, or with ``lenient`` are passed over."""
    reader = spark.read.options(sep=sep, header=header, quote=quote, mode=_mode(lenient), enforceSchema=False)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)


def read_csv_text(spark: SparkSession, text: str | bytes, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, lenient: bool = False) -> DataFrame:
    """CSV that the driver holds: values that come with a request, not data at scale. With ``lenient`` a table whose columns don't fit adds no rows."""
    text = text.decode() if isinstance(text, bytes) else text
    records = [x for x in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if x]
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if kind is not None and records and (len(records[0]) != len(kind) or header and records[0] != kind.names):
        if lenient:
            return spark.createDataFrame([], kind)
        raise ValueError(f"The CSV has columns {records[0]!r}, the schema has {kind.names}.")
    # a record may hold quoted separators and line ends
    again = io.StringIO()
    body = []
    for x in records[1:] if header and kind is not None else records:
        csv.writer(again, delimiter=sep, lineterminator="").writerow(x)
        body.append(again.getvalue())
        again.seek(0)
        again.truncate()
    rows = spark.createDataFrame([(x,) for x in body], "value string")
    if kind is not None:
        parsed = rows.select(F.from_csv("value", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind), {"sep": sep, "escape": '"', "mode": "PERMISSIVE" if lenient else "FAILFAST"}).alias("row"))
        return parsed.select("row.*")
    import pandas as pd

    return spark.createDataFrame(pd.read_csv(io.StringIO(text), sep=sep, header=0 if header else None))


def read_json_lines(spark: SparkSession, source: str | bytes, schema: T.StructType | str | None = None, lenient: bool = False) -> DataFrame:
    """JSON lines: a path, or the bytes themselves."""
    reader = spark.read.option("mode", _mode(lenient))
    reader = reader.schema(schema) if schema is not None else reader
    if isinstance(source, str):
        return reader.json(source)
    lines = [x for x in source.decode().splitlines() if x.strip()]
    if schema is None:
        # of all lines, as for files
        schema = spark.read.json(spark.sparkContext.parallelize(lines)).schema if lines else "value string"
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    return rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE" if lenient else "FAILFAST"}).alias("row")).select("row.*")


def read_json_values(spark: SparkSession, values: str | list, schema: T.StructType | str) -> DataFrame:
    """A JSON array of objects, typed by ``schema``. Anything but an array, and a missing field, raises; unsigned types are the next wider signed ones."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    found = json.loads(values) if isinstance(values, str) else values
    if not isinstance(found, list):
        raise ValueError("The JSON values must be an array of objects.")
    for value in found:
        missing = [f.name for f in kind if f.name not in value]
        if missing:
            raise ValueError(f"The JSON values lack {missing}.")
    rows = spark.createDataFrame([(json.dumps(found),)], "value string")
    return rows.select(F.inline(F.from_json("value", T.ArrayType(kind), {"mode": "FAILFAST"})))


def _signed(schema: pa.Schema) -> pa.Schema:
    """Unsigned types as the next wider signed ones, lists of a fixed size as lists."""
    wider = {pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20, 0)}
    fields = []
    for f in schema:
        kind = f.type
        if pa.types.is_fixed_size_list(kind) or pa.types.is_list(kind):
            kind = pa.list_(wider.get(kind.value_type, kind.value_type))
        fields.append(pa.field(f.name, wider.get(kind, kind)))
    return pa.schema(fields)


def _arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    if table.num_rows == 0:
        raise ValueError("The Arrow source has no record batches.")
    batches = [i for i, b in enumerate(table.to_batches()) for _ in range(b.num_rows)]
    table = table.append_column(BATCH, pa.array(batches, pa.int64())).append_column(ROW, pa.array(range(table.num_rows), pa.int64()))
    return spark.createDataFrame(table.cast(_signed(table.schema)))


def _parsed(schema: pa.Schema):
    """(path, content, before) of whole files to their rows, with batch numbers from ``before`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for content, before in zip(given.column(1), given.column(2).to_pylist(), strict=True):
                at = 0
                with ipc.open_file(content.as_buffer()) as reader:
                    for i in range(reader.num_record_batches):
                        batch = reader.get_batch(i).cast(schema)
                        n = batch.num_rows
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([before + i] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())], [*schema.names, BATCH, ROW])
                        at += n

    return run


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, content) to (path, schema, batches, rows)."""
    for given in batches:
        for path, content in zip(given.column(0), given.column(1), strict=True):
            with ipc.open_file(content.as_buffer()) as reader:
                kind, n = reader.schema.serialize().to_pybytes(), reader.num_record_batches
                yield pa.RecordBatch.from_pydict({"path": [path.as_py()], "kind": [kind], "n": [n], "rows": [sum(reader.get_batch(i).num_rows for i in range(n))]})


def read_ipc_file(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file, or a folder of them, that all machines reach; record batches are the batches, files follow by path.

    The executors parse the files, each as a whole: one of over 2 GB raises. All must have the
    first one's columns and types. A folder or file without rows raises.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = files.mapInArrow(_described, "path string, kind binary, n long, rows long").where("rows > 0")
    first = found.orderBy("path").limit(1).collect()
    if not first:
        raise ValueError("The Arrow source has no record batches.")
    schema = _signed(ipc.read_schema(pa.BufferReader(first[0]["kind"])))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.join(found.select("path", before.alias("before")), "path")
    kinds = T.StructType([*from_arrow_schema(schema), T.StructField(BATCH, T.LongType()), T.StructField(ROW, T.LongType())])
    return placed.mapInArrow(_parsed(schema), kinds)


def read_ipc_stream(spark: SparkSession, data: bytes) -> DataFrame:
    with ipc.open_stream(data) as reader:
        return _arrow(spark, reader.read_all())


def ipc_metadata(data: bytes) -> dict[str, str]:
    """What goes with the schema of an Arrow stream."""
    with ipc.open_stream(data) as reader:
        return {k.decode(): v.decode() for k, v in (reader.schema.metadata or {}).items()}


def read_record_batches(spark: SparkSession, batches: list[pa.RecordBatch]) -> DataFrame:
    """Record batches, or a reader of them."""
    return _arrow(spark, pa.Table.from_batches(list(batches)))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
