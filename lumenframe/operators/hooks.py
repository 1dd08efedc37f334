"""Functions of the caller's own inside a plan: batch by batch, by name, with a set-up, and watched from outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Functions by name, as a recipe names them.
NAMED: dict[str, Callable] = {}


def named(name: str) -> Callable[[Callable], Callable]:
    """Register a function under a name."""

    def add(f: Callable) -> Callable:
        NAMED[name] = f
        return f

    return add


def mapped(df: DataFrame, f: Callable | str, schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """``f(batch)`` (with a set-up: ``f(batch, state)``) for every Arrow batch, in parallel over the partitions.

    The set-up runs once a task, before its first batch: a model or a table is loaded there.
    """
    call = NAMED[f] if isinstance(f, str) else f

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for b in batches:
            yield call(b, state) if setup else call(b)

    return df.mapInArrow(run, schema)


def zipped(lists: list[str], lengths: str = "error") -> Column:
    """Lists of equal length as one list of structs, for a function that takes an element of each; lists of other lengths
    fail, when run, or give null (``lengths="null"``)."""
    same = F.lit(True)
    for c in lists[1:]:
        same = same & (F.size(c) == F.size(lists[0]))
    other = F.lit(None) if lengths == "null" else F.raise_error("the lists differ in length")
    return F.when(same, F.arrays_zip(*lists)).otherwise(other)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The frame, and an observation that has the metrics once an action has run through it; nothing is computed twice."""
    o = Observation()
    return df.observe(o, *[c.alias(n) for n, c in metrics.items()]), o
