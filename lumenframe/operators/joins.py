"""Joins that relational engines lack or that clips need: overlap, as-of, nearest, spans, plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import C, col
from ..tables import prefix
from .scans import scanned

#: Bytes up to which a dimension side is broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if Spark's own estimate of its size is at most ``most`` bytes; else as it is.

    Nothing runs. A frame of unknown size gets no hint: adaptive execution measures it when it is there.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= most else df


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join by columns of the same name, where a null meets a null; the columns come from the left."""
    hid = prefix(left, right)
    side, same = right.withColumnsRenamed({c: f"{hid}m_{c}" for c in on}), F.lit(True)
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"{hid}m_{c}")) & same
    return left.join(side, same, how).drop(*[f"{hid}m_{c}" for c in on])


def with_presets(df: DataFrame, key: str, presets: DataFrame, preset_key: str, defaults: dict[str, object]) -> DataFrame:
    """Add the preset columns of each row's key; defaults where there is no preset."""
    hid = prefix(df, presets)
    side = presets.withColumnRenamed(preset_key, f"{hid}key").select(f"{hid}key", *defaults)
    out = df.join(small(side), F.col(key) == F.col(f"{hid}key"), "left").drop(f"{hid}key")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def required(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Inner join that fails, when run, on a row without a match."""
    hid = prefix(df, other)
    side = other.withColumn(f"{hid}there", F.lit(True))
    out = df.join(side, on, "left")
    said = F.concat(F.lit("no match for "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    return out.where(F.when(F.col(f"{hid}there"), F.lit(True)).otherwise(F.raise_error(said).cast("boolean"))).drop(f"{hid}there")


def overlap_join(blocks: DataFrame, windows: DataFrame, on: list[str], majority: tuple[int, int] = (1, 2)) -> DataFrame:
    """Windows (left, right) matched to blocks (start, stop) that cover more than ``majority`` of the window's length.

    Strict, in integers: an exact tie matches nothing. The equality part of the key lets the
    join hash or sort; the range is a residual condition. Blocks without a match stay, with nulls.
    """
    hid = prefix(blocks, windows)
    p, q = majority
    side = windows.withColumnsRenamed({c: f"{hid}w_{c}" for c in on})
    common = F.greatest(F.lit(0), F.least("stop", "right") - F.greatest("start", "left"))
    same = [F.col(c) == F.col(f"{hid}w_{c}") for c in on]
    hit = (F.col("right") > F.col("left")) & (common * q > p * (F.col("right") - F.col("left")))
    condition = hit
    for s in same:
        condition = s & condition
    return blocks.join(side, condition, "left").drop(*[f"{hid}w_{c}" for c in on])


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False) -> DataFrame:
    """For each left row the last right row of its key at or before its time (before it, if strict).

    Both sides are unioned and sorted once by key and time; the last right row seen is carried
    on. Among right rows of equal time the one with the greatest columns counts.
    """
    hid = prefix(left, right)
    payload = F.struct(right_time, *columns)
    l = left.withColumns({f"{hid}t": F.col(left_time), f"{hid}side": F.lit(0 if strict else 1), f"{hid}r": F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType), f"{hid}row": F.struct(*left.columns)})  # noqa: E741
    r = right.withColumns({f"{hid}t": F.col(right_time), f"{hid}side": F.lit(1 if strict else 0), f"{hid}r": payload})
    keep = [*on, f"{hid}t", f"{hid}side", f"{hid}r"]
    row_type = l.schema[f"{hid}row"].dataType
    both = l.select(*keep, f"{hid}row").unionByName(r.select(*keep).withColumn(f"{hid}row", F.lit(None).cast(row_type)))
    # a scan in parts: a key with a third of the rows has many tasks
    out = scanned(both, on, [f"{hid}t", f"{hid}side", f"{hid}r"], F.col(f"{hid}r"), f"{hid}last", "last").where(F.col(f"{hid}row").isNotNull())
    return out.select(f"{hid}row.*", *[F.col(f"{hid}last.{c}").alias(c if c not in left.columns else f"right_{c}") for c in [right_time, *columns]])


def bucket_of(df: DataFrame, by: list[str], position: str, runs: DataFrame, order: str, length: str, columns: list[str]) -> DataFrame:
    """The run that holds each position, for runs of given lengths laid end to end in each group."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("run_start", F.coalesce(F.sum(length).over(w), F.lit(0)))
    found = asof_join(df, starts, by, position, "run_start", [length, *columns])
    return found.where(F.col(position) < F.col("run_start") + F.col(length))


#: Vectors of a block, of which two are compared at a time.
BLOCK_VECTORS = 1024


def largest_distance(df: DataFrame, by: list[str], key: str, vector: str, block_vectors: int = BLOCK_VECTORS) -> DataFrame:
    """Largest distance between two vectors of each group, 0 for a single one.

    A counted group is cut into blocks of about ``block_vectors`` vectors by its keys' hash;
    every pair of blocks is a group of rows of bounded size, in which a task compares all
    vectors by matrix products. A large group is spread over many tasks, and no row stands for
    a pair. Null vectors do not count; vectors of a group have one length.
    """
    hid = prefix(df)
    rows = df.where(F.col(vector).isNotNull()).select(*by, F.xxhash64(key).alias(f"{hid}h"), F.transform(vector, lambda x: x.cast("double")).alias(f"{hid}v"))
    shape = rows.groupBy(*[F.col(c).alias(f"{hid}g_{c}") for c in by]).agg(F.ceil(F.count("*") / block_vectors).cast("int").alias(f"{hid}blocks"))
    same = F.lit(True)
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"{hid}g_{c}")) & same
    rows = rows.join(shape, same).withColumn(f"{hid}b", F.pmod(f"{hid}h", f"{hid}blocks").cast("int")).withColumn(f"{hid}o", F.explode(F.sequence(F.lit(0), F.col(f"{hid}blocks") - 1)))
    pairs = rows.select(*by, F.least(f"{hid}b", f"{hid}o").alias(f"{hid}x"), F.greatest(f"{hid}b", f"{hid}o").alias(f"{hid}y"), (F.col(f"{hid}b") > F.col(f"{hid}o")).alias(f"{hid}right"), f"{hid}v")

    def most(keys: tuple, table: pa.Table) -> pa.Table:
        v = table.column(f"{hid}v").combine_chunks()
        m = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        right = table.column(f"{hid}right").to_numpy()
        a, b = (m[~right], m[right]) if keys[-2].as_py() != keys[-1].as_py() else (m, m)
        best = 0.0
        for i in range(0, len(a) if len(b) else 0, 256):
            x = a[i : i + 256]
            square = (x * x).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * x @ b.T
            # the product cancels digits: the farthest are measured directly
            p, q = np.nonzero(square >= square.max() * (1 - 1e-9) - 1e-9)
            best = max(best, float(((x[p] - b[q]) ** 2).sum(axis=1).max()))
        return pa.table([pa.array([k.as_py()], k.type) for k in keys[: len(by)]] + [pa.array([best], pa.float64())], names=[*by, f"{hid}s"])

    out = T.StructType([*[df.schema[c] for c in by], T.StructField(f"{hid}s", T.DoubleType())])
    return pairs.groupBy(*by, f"{hid}x", f"{hid}y").applyInArrow(most, out).groupBy(*by).agg(F.sqrt(F.max(f"{hid}s")).alias("span"))


def key_diff(planned: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, status), missing if planned but not there, extra if there but not planned."""
    missing = planned.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("status", F.lit("missing"))
    extra = actual.select(key).distinct().join(planned.select(key), key, "left_anti").withColumn("status", F.lit("extra"))
    return missing.unionByName(extra)


def first_owner(df: DataFrame, key: list[str], rank: str, name: str = "owner") -> DataFrame:
    """One publisher per key: the least rank that needs it."""
    return df.groupBy(*key).agg(F.min(rank).alias(name))


def enclosing_block(df: DataFrame, by: list[str], caption: str, position: str, block: str) -> DataFrame:
    """The block of the first position of each caption."""
    return df.groupBy(*by, caption).agg(F.min_by(block, position).alias(block))


def support_frames(df: DataFrame, anchor: C, last: C) -> DataFrame:
    """Four frames that support a latent: its anchor and the three before, kept inside the clip: (k, frame)."""
    out = df.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return out.withColumn("frame", F.least(F.greatest(col(anchor) - 3 + F.col("k"), F.lit(0)), col(last)))


def indexed(df: DataFrame, rows: DataFrame, by: list[str], index: str, columns: list[str]) -> DataFrame:
    """Rows by number in their group; -1 means none and gives nulls."""
    hid = prefix(df, rows)
    side = rows.select(*[F.col(c).alias(f"{hid}r_{c}") for c in by], F.col(index).alias(f"{hid}i"), *columns)
    same = (F.col(index) == F.col(f"{hid}i")) & (F.col(index) >= 0)
    for c in by:
        same = (F.col(c) == F.col(f"{hid}r_{c}")) & same
    return df.join(side, same, "left").drop(f"{hid}i", *[f"{hid}r_{c}" for c in by])


def shared_text(df: DataFrame, doc: list[str], view: str, text: str) -> DataFrame:
    """Documents whose views all have the same text, and as many texts as views: (doc, shared)."""
    return df.groupBy(*doc).agg(((F.count_distinct(F.coalesce(F.sha2(text, 256), F.lit(""))) == 1) & (F.count(text) == F.count_distinct(view))).alias("shared"))


def changed_since(now: DataFrame, before: DataFrame, key: str, ignored: list[str], allowed: list[str]) -> DataFrame:
    """Rows of a saved state that differ from the present: (key, status), where changes of allowed columns are reported as such."""
    hid = prefix(now, before)
    kept = [c for c in now.columns if c != key and c not in ignored and c not in allowed]
    digest = lambda cols, n: F.sha2(F.to_json(F.struct(*sorted(cols))), 256).alias(n)
    a = now.select(key, digest(kept, "strict"), digest(allowed, "loose") if allowed else F.lit("").alias("loose"))
    b = before.select(F.col(key).alias(f"{hid}key"), digest(kept, f"{hid}strict"), digest(allowed, f"{hid}loose") if allowed else F.lit("").alias(f"{hid}loose"))
    status: Column = F.when(F.col(f"{hid}key").isNull(), "new").when(F.col(key).isNull(), "gone").when(F.col("strict") != F.col(f"{hid}strict"), "stale").when(F.col("loose") != F.col(f"{hid}loose"), "allowed").otherwise("same")
    return a.join(b, F.col(key) == F.col(f"{hid}key"), "full").select(F.coalesce(key, f"{hid}key").alias(key), status.alias("status"))


def late_columns(light: DataFrame, path: str, id_column: str, columns: list[str]) -> DataFrame:
    """Fetch heavy columns for the rows that a light scan left: a second scan joined on the row id.

    The ids are counted; up to the bound they are broadcast, so that the heavy scan is filtered
    in place and not shuffled.
    """
    heavy = light.sparkSession.read.parquet(path).select(id_column, *columns)
    ids = light.select(id_column)
    wanted = heavy.join(small(ids), id_column, "left_semi")
    return light.join(wanted, id_column)
