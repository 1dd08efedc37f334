"""Intermediate tables in the shared folder that the cluster names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from .session import checkpoint_root

_OPEN: list[list[DataFrame]] = []


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while (name := f"_{stem}").lower() in taken:
            stem = f"_{stem}"
        taken.add(name.lower())
        out.append(name)
    return out


def prefix(*frames: DataFrame) -> str:
    """A prefix that no column of the tables begins with, for the helper columns of an operator."""
    out = "_"
    while any(c.startswith(out) for df in frames for c in df.columns):
        out += "_"
    return out


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither repeat its work nor depend on executors."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/lumenframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote and nothing reads any more."""
    if path := getattr(df, "_saved_path", None):
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


#: Bytes of the files below a table for each partition of its shuffles.
PART_BYTES = 8 << 20


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle of a table: as many as the bytes of the files that it comes from ask for, the session's number at least.

    Sorts then hold as much in a task for a large table as for a small one. Only of files does Spark know the bytes; its guess for a join is the product of its sides.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()) if "LogicalRelation" in leaves.apply(i).getClass().getName())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found // PART_BYTES))


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``saved`` writes inside are deleted at the end; results that read them must be written before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for df in _OPEN.pop():
            dropped(df)
