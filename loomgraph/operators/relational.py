"""Projection, predicates, joins, order, limits and unions."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..subjects import HIDDEN, same_schema, visible

#: Types that take part where only supported columns are asked for.
SUPPORTED = ("string", "int", "bigint", "float")


def project(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in the table's own order; unknown names are passed over."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in names or c in HIDDEN])


def columns_of_types(df: DataFrame, kinds: tuple[str, ...] = SUPPORTED) -> list[str]:
    return [c for c, kind in df.dtypes if kind in kinds]


def fields_in_schemas(a: DataFrame, b: DataFrame) -> list[str]:
    """Names of the fields that both have with one type."""
    other = {(f.name, f.dataType) for f in b.schema}
    return [f.name for f in a.schema if (f.name, f.dataType) in other]


def null_counts(df: DataFrame) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def assert_not_null(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, whose rows raise as they are read if one of the columns is null."""
    checked = {c: F.coalesce(F.col(c), F.raise_error(F.lit(f"Invalid batch column '{c}' has null but it is declared not null")).cast(dict(df.dtypes)[c])) for c in names}
    return df.withColumns(checked)


def filter_equal(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_in(df: DataFrame, **values: list) -> DataFrame:
    """Rows whose every given column is in its list."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isin(v) for c, v in values.items()], F.lit(True)))


def filter_contains(df: DataFrame, column: str, part: str) -> DataFrame:
    return df.where(F.contains(F.col(column), F.lit(part)))


def _defaulted(df: DataFrame, names: list[str]) -> DataFrame:
    """Nulls of text and numbers as the empty string and zero."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit("" if kind == "string" else 0).cast(kind)) for c, kind in df.dtypes if c in names and kind in SUPPORTED})


def join_inner(lhs: DataFrame, rhs: DataFrame, lhs_fk: str, rhs_fk: str, null_mode: str = "sql", supported_only: bool = False) -> DataFrame:
    """Rows of both sides with equal keys; duplicates multiply.

    Keys keep both columns; where names of the sides meet, the right one is dropped if it is the
    key, else it gets the suffix ``_rhs``. ``null_mode="default"`` has nulls of keys and values as
    the empty string and zero, so that null keys meet. Catalyst picks the strategy.
    """
    lhs, rhs = visible(lhs), visible(rhs)
    if supported_only:
        lhs, rhs = lhs.select(*columns_of_types(lhs)), rhs.select(*columns_of_types(rhs))
    if null_mode == "default":
        lhs, rhs = _defaulted(lhs, lhs.columns), _defaulted(rhs, rhs.columns)
    names = {c: f"{c}_rhs" if c in lhs.columns else c for c in rhs.columns}
    right = rhs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = lhs.join(right, F.col(f"`{lhs_fk}`") == F.col(f"`{names[rhs_fk]}`"))
    return out.drop(names[rhs_fk]) if lhs_fk == rhs_fk else out


def join_tables(lhs: DataFrame, rhs: DataFrame, on: list[str] | Column, how: str = "inner") -> DataFrame:
    """An extension: any Spark join."""
    return lhs.join(rhs, on, how)


def sort_scores(df: DataFrame, score: str, key: str | None = None, ascending: bool = False, supported_only: bool = False) -> DataFrame:
    """Rows by score, ties by key; descending by default."""
    if supported_only:
        df = df.select(*[c for c, kind in df.dtypes if c == score or kind in ("string", "int", "bigint")])
    by = F.col(score).asc() if ascending else F.col(score).desc()
    return df.orderBy(by, *([F.col(key)] if key else []))


def limit_offset(df: DataFrame, offset: int = 0, fetch: int | None = None) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if fetch is None else df.limit(fetch)


def top_k(df: DataFrame, score: str, k: int, partition: str | None = None, tie: str | None = None, ascending: bool = False) -> DataFrame:
    """The k best rows, of every ``partition`` if one is named; Spark keeps k rows a task before the exchange."""
    by = [F.col(score).asc() if ascending else F.col(score).desc(), *([F.col(tie)] if tie else [])]
    if partition is None:
        return df.orderBy(*by).limit(k)
    if "rank" in df.columns:
        raise ValueError("The table has a column rank already.")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*by))).where(F.col("rank") <= k)


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; schemas must be equal."""
    if not tables:
        raise ValueError("There are no tables to unite.")
    for other in tables[1:]:
        if not same_schema(tables[0], other):
            raise ValueError(f"Schemas differ: {visible(tables[0]).schema.simpleString()} and {visible(other).schema.simpleString()}.")
    return reduce(DataFrame.unionByName, tables)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def collect_partitions(df: DataFrame) -> list[list]:
    """Rows by partition, in order; for results that leave the engine."""
    rows = df.withColumn("_partition_number", F.spark_partition_id()).collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["_partition_number"], []).append(tuple(r)[:-1])
    return [out[p] for p in sorted(out)]
