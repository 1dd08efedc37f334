"""Ordered scans inside groups, without bringing a group to one task.

Rows are range-partitioned by group and order, so that a large group has many parts. What a part hands on (its last
value, its greatest, its last row's) is a row a part; a scan over those, in order, gives each part what stands before it. Together
that is the scan of the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import unused
from .sampling import _dealt

#: By kind: (what a row sees inside its part, what a part hands on, how a part gathers what was handed on, how the two meet).
KINDS = {
    # the last value that is not null, of this row or one before
    "last": (
        lambda v, row, w: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda v, row: F.max_by(v, F.when(F.col(v).isNotNull(), F.col(row))),
        lambda v, w: F.last(v, ignorenulls=True).over(w),
        F.coalesce,
    ),
    # the greatest value of this row and those before
    "greatest": (lambda v, row, w: F.max(v).over(w.rowsBetween(Window.unboundedPreceding, 0)), lambda v, row: F.max(v), lambda v, w: F.max(v).over(w), F.greatest),
    # the value of the row before, null or not, in a struct; null where there is none
    "previous": (lambda v, row, w: F.lag(F.struct(F.col(v).alias("value"))).over(w), lambda v, row: F.max_by(F.struct(F.col(v).alias("value")), row), lambda v, w: F.last(v).over(w), F.coalesce),
}


def scanned(df: DataFrame, by: list[str], order: list[str], value: Column, name: str, kind: str, parts: int = 0) -> DataFrame:
    """Add what each row sees of the rows up to it (``last``, ``greatest``) or just before it (``previous``) in its group.

    Groups may be null. A column of the result's name is replaced; no other one is touched.
    """
    inside, handed, gathered, meet = KINDS[kind]
    names = [c for c in df.columns if c != name]
    own, seen, whole, start, other, *groups = unused(df, "value", "seen", "whole", "start", "p", *[f"g_{c}" for c in by])
    rows, row, part = _dealt(df.withColumn(own, value), [*by, *order], parts)
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, part).agg(handed(own, row).alias(whole)).withColumn(start, gathered(whole, before))
    side = ends.where(F.col(start).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(part).alias(other), start)
    same = F.col(part) == F.col(other)
    for c, g in zip(by, groups, strict=True):
        same = F.col(c).eqNullSafe(F.col(g)) & same
    out = rows.withColumn(seen, inside(own, row, Window.partitionBy(*by, part).orderBy(row)))
    return out.join(side, same, "left").select(*names, meet(F.col(seen), F.col(start)).alias(name))
