"""Where queries and their SQL are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with equivalent DuckDB SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit_sql(salt: str, *keys: str) -> str:
    """The draw of functions.scalar.unit, in DuckDB SQL."""
    parts = ", ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{salt}', {parts})), 1, 8) AS BIGINT) / 4294967296.0)"
