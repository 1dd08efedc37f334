"""Event-time windows and stateful operators over streams.

Zone-less timestamps are cast to TIMESTAMP first, as watermarks need; run sessions in UTC.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import checkpoint_root
from ..tables import dropped, saved
from .state import agreed_reuse, carried_over, changed_tokens, consumption, held_rows, outstanding, queued_documents, reuse_limited, sliding_history  # noqa: F401


def event_stream(spark: SparkSession, path: str, schema: str, time: str = "ts", files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream, its time column as TIMESTAMP."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(df: DataFrame, by: list[str], time: str, width: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in tumbling (or, with a slide, hopping) windows; rows later than ``late`` are dropped."""
    df = df.withWatermark(time, late) if late else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return df.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n", "total")


def sessions(df: DataFrame, by: list[str], time: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions that end after a gap: (start, stop, n)."""
    df = df.withWatermark(time, late) if late else df
    return df.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *by, "n")


def first_of_each(df: DataFrame, key: list[str], time: str, late: str) -> DataFrame:
    """One row per key within the lateness bound."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def span_of(df: DataFrame, time: str) -> str:
    """The time between a table's first and last row, rounded up: a lateness bound that drops none of its rows, in any order."""
    r = df.agg(F.min(F.unix_seconds(time)).alias("a"), F.max(F.unix_seconds(time)).alias("b")).first()
    return f"{(r.b or 0) - (r.a or 0) + 1} seconds"


def joined_streams(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Rows of two streams of the same key, the right one at most ``within`` after the left."""
    l, r = left.withWatermark(left_time, late).alias("l"), right.withWatermark(right_time, late).alias("r")  # noqa: E741
    near = F.expr(f"l.{key} = r.{key} AND r.{right_time} >= l.{left_time} AND r.{right_time} <= l.{left_time} + INTERVAL {within}")
    return l.join(r, near)


def fresh_values(df: DataFrame, key: str, time: str, value: str, now: str, interval: float) -> DataFrame:
    """Latest value of each key, or null if it is older than three intervals at its key's ``now``; never 0 for want of a value."""
    last = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, time).alias("value"), F.max(time).alias("at"))
    clock = df.groupBy(key).agg(F.max(now).alias("now"))
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return clock.join(last, key, "left").select(key, F.when(age <= int(3 * interval * 1e6), F.col("value")).alias("value"), "now")


#: Bytes of a file of a replayed table; so many are a batch, which a key's task holds.
FILE_BYTES = 64 << 20
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which maps and timers need; the session's own setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _in_order(spark: SparkSession, path: str) -> int:
    """Give the files of a folder ascending times in the order of their names, by which a stream takes them; the number of files.

    One call a file, from the driver; no data is moved. A store that keeps no times of its own is refused.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(hadoop) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    first = fs.getFileStatus(hadoop).getModificationTime() - 1000 * len(files)
    for i, f in enumerate(files):
        fs.setTimes(f, first + 1000 * i, -1)
    times = [fs.getFileStatus(f).getModificationTime() for f in files]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError(f"{path}: the store keeps no modification times, so the files cannot be replayed in order")
    return len(files)


def replayed(df: DataFrame, order: list[str], parts: int = 0, files_per_trigger: int = 1) -> DataFrame:
    """A table as a stream: its rows, in order, in files of the shared folder, some files a batch.

    Each file has a range of the order and a time after that of the file before, so batches are in order
    and hold ranges that do not overlap. The files are as many as the table's bytes ask for, four at least.
    """
    given = df
    if not parts:
        df = saved(df)  # only of files does Spark know the bytes; its guess for a join is the product of its sides
        parts = max(4, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // FILE_BYTES)
    rows = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    if df is not given:
        dropped(df)
    _in_order(df.sparkSession, rows._saved_path)
    # ages are not looked at: a replayed table is read from its first file, however long ago that was written
    reader = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", "36500d")
    return reader.parquet(rows._saved_path)


def started(df: DataFrame, root: str, mode: str = "append") -> StreamingQuery:
    """Start a stream that writes every batch into a folder of its own under ``root``/rows, its state under ``root``/state."""
    write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
    with rocks_store(df.sparkSession):
        return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()


def new_root(spark: SparkSession) -> str:
    """A new folder for a stream, in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/lumenframe/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def finished(df: DataFrame, mode: str = "append", key: list[str] = (), root: str | None = None) -> DataFrame:
    """Drive a stream over all available input into the shared folder, and read the outcome.

    Every batch overwrites a folder of its own, so that a repeated batch counts once. The
    outcome is all rows (append), the last batch (complete), or the last row of each key (update). With a ``root`` of
    an earlier run, the stream goes on from where that one stopped.
    """
    spark = df.sparkSession
    root = root or new_root(spark)
    started(df, root, mode).awaitTermination()
    return outcome(spark, df.schema, root, mode, key)


def outcome(spark: SparkSession, schema, root: str, mode: str = "append", key: list[str] = ()) -> DataFrame:
    """What a stream has written under ``root`` so far, as ``finished`` reads it."""
    out = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, batch long").parquet(f"{root}/rows")
    if mode == "complete":
        last = out.agg(F.max("batch")).first()[0]
        return out.where(F.col("batch") == last).drop("batch")
    if mode == "update":
        row = F.max_by(F.struct(*schema.names), "batch").alias("_r")
        return out.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(row).select("_r.*")
    return out.drop("batch")


def guarded(df: DataFrame, order: list[str], path: str) -> DataFrame:
    """The table, after a check that it is the one that a saved cursor was made for.

    The first call records the number of rows and a digest of their order in ``path``; later
    calls raise where either differs, as a cursor would then point to other rows.
    """
    from ..operators.sampling import numbered
    from ..operators.stats import fingerprint

    now = fingerprint(numbered(df.select(*order), order, "_n").withColumn("_g", F.lit(0)), ["_g"], [*order, "_n"]).select("n", "fingerprint")
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        now.coalesce(1).write.json(path)
        return df
    row, old = now.first(), spark.read.schema("n long, fingerprint string").json(path).first()
    if row is None or (row.n, row.fingerprint) != (old.n, old.fingerprint):
        raise ValueError(f"the source has changed since its cursor was saved: {old.n} rows then, {row.n if row else 0} now, or another order")
    return df


def run_to_end(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Drive a stream over all available input into an in-memory table, for tests and small reports."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    with rocks_store(df.sparkSession):
        q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Write a stream as Parquet, each batch committed once."""
    with rocks_store(df.sparkSession):
        return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
