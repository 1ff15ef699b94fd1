"""Overlapping chunks of document texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..subjects import visible


def chunk_documents(df: DataFrame, pk: str, text: str, size: int = 512, overlap: int = 64, chunk_id: str = "chunk_id", supported_only: bool = False) -> DataFrame:
    """A row per chunk of ``size`` characters, each ``overlap`` into the one before; other columns are repeated.

    ``chunk_id`` is ``key_i``. Nulls and empty texts are one chunk as they are. Narrow: no exchange.
    """
    if not 0 <= overlap < size:
        raise ValueError(f"The overlap {overlap} must be less than the size {size}.")
    df = visible(df)
    if supported_only:
        from .relational import columns_of_types

        df = df.select(*columns_of_types(df))
    step = size - overlap
    n = F.when(F.length(text) > size, F.ceil((F.length(text) - overlap) / F.lit(step))).otherwise(1).cast("int")
    rows = df.withColumn("_chunk_number", F.explode(F.sequence(F.lit(0), n - 1)))
    others = [c for c in df.columns if c not in (text, chunk_id)]
    return rows.select(F.concat_ws("_", F.col(pk).cast("string"), F.col("_chunk_number").cast("string")).alias(chunk_id), *others, F.substring(F.col(text), F.col("_chunk_number") * step + 1, F.lit(size)).alias(text))
