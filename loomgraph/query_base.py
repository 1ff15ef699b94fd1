"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Examples that read no table, and what they give: they are tested like queries, but are none.
EXAMPLES: dict = {}
EXAMPLE_SQL: dict[str, str] = {}


def example(sql: str):
    """Keep a function of (spark, sf_dir) that reads no table for the tests."""

    def add(f):
        EXAMPLES[f.__name__], EXAMPLE_SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
