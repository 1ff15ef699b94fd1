"""Sinks. The text and stream forms gather a table on the driver: they are for small results that leave the engine."""

import io
import json

import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..subjects import BATCH, HIDDEN, visible


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(*[c for c in HIDDEN if c in df.columns]) if BATCH in df.columns else df


def _batches(df: DataFrame) -> list[pa.RecordBatch]:
    if BATCH not in df.columns:
        return df.toArrow().to_batches()
    table = _ordered(df).toArrow()
    ids = table[BATCH].to_numpy()
    plain = table.drop_columns([c for c in HIDDEN if c in table.column_names])
    cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
    return [plain.slice(a, b - a).combine_chunks().to_batches()[0] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def to_ipc_stream(df: DataFrame, metadata: dict[str, str] | None = None) -> bytes:
    """An Arrow stream of the table's batches; ``metadata`` goes with its schema."""
    batches = _batches(df)
    if not batches:
        raise ValueError("There is nothing to write: the table has no record batches.")
    out = io.BytesIO()
    with ipc.new_stream(out, batches[0].schema.with_metadata(metadata)) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return out.getvalue()


def write_ipc_file(df: DataFrame, path: str) -> None:
    """An Arrow file of the table's batches at any path that Spark can write to."""
    batches = _batches(df)
    if not batches:
        raise ValueError("There is nothing to write: the table has no record batches.")
    made = io.BytesIO()
    with ipc.new_file(made, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    context = df.sparkSession.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    try:
        out.write(bytearray(made.getvalue()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, quote: str = "'", null_value: str = "NULL") -> None:
    """A folder of CSV files; read_csv takes the same options for the way back."""
    visible(df).write.mode("overwrite").options(sep=sep, header=header, quote=quote, nullValue=null_value).csv(path)


def to_csv_text(df: DataFrame, sep: str = ",", header: bool = True, quote: str = "'", null_value: str = "NULL") -> str:
    plain = visible(df)
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in plain.columns]), {"sep": sep, "quote": quote, "nullValue": null_value})
    order = [F.col(c) for c in HIDDEN if c in df.columns]
    rows = [r[0] for r in df.orderBy(*order).select(line).collect()] if order else [r[0] for r in df.select(line).collect()]
    return "".join(x + "\n" for x in [*([sep.join(plain.columns)] if header else []), *rows])


def to_json_lines(df: DataFrame) -> str:
    plain = visible(df)
    return "".join(r[0] + "\n" for r in _ordered(df).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in plain.columns]))).collect())


def to_json_bytes(df: DataFrame) -> bytes:
    """The rows as one JSON array."""
    return json.dumps(to_json_objects(df), default=str).encode()


def to_json_objects(df: DataFrame) -> list[dict]:
    """Rows as dicts, nulls left out."""
    return [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in visible(_ordered(df)).collect()]


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = visible(df).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
