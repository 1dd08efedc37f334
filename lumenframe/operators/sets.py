"""Unions of sources and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import prefix


def union_sources(parts: dict[str, DataFrame], name: str = "origin") -> DataFrame:
    """All sources as one, columns matched by name, absent ones null, with the source's name and rank."""
    tagged = [df.withColumns({name: F.lit(k), f"{name}_rank": F.lit(i).cast("long")}) for i, (k, df) in enumerate(parts.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def first_wins(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row per key, from the first source that has it."""
    from .stats import first_occurrences

    both = union_sources(parts)
    order = ["origin_rank", *[c for c in both.columns if c != "origin_rank" and c not in key]]
    return first_occurrences(both, key, order)


def difference(a: DataFrame, b: DataFrame, keep_copies: bool = False) -> DataFrame:
    """Rows of a that b lacks; with ``keep_copies`` as many as a has more."""
    return a.exceptAll(b) if keep_copies else a.subtract(b)


def common(a: DataFrame, b: DataFrame, keep_copies: bool = False) -> DataFrame:
    return a.intersectAll(b) if keep_copies else a.intersect(b)


def in_requested_order(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows of the wanted keys, each as often as asked, with its place in the list; the list is the caller's, so it is small."""
    hid = prefix(df)
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    ask = spark.createDataFrame(list(enumerate(wanted)), f"place long, {hid}k {kind}")
    return df.join(F.broadcast(ask), F.col(key) == F.col(f"{hid}k")).drop(f"{hid}k")
