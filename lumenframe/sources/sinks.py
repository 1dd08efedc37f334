"""Sinks: appended metrics, committed generations, retention, caches, shards and provenance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import C, col
from ..tables import prefix


def append_metrics(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def commit_generation(df: DataFrame, root: str, step: int, **facts) -> None:
    """Write a generation's data, then its manifest row; readers see a generation by its manifest only."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/step={step:012d}")
    row = spark.createDataFrame([(step, f"step={step:012d}", {k: str(v) for k, v in facts.items()})], "step long, folder string, facts map<string,string>")
    row.coalesce(1).write.mode("append").json(f"{root}/_manifests")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of committed generations; none if nothing was committed."""
    try:
        return spark.read.schema("step long, folder string, facts map<string,string>").json(f"{root}/_manifests")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "step long, folder string, facts map<string,string>")
        raise


def latest(spark: SparkSession, root: str) -> DataFrame | None:
    """Data of the newest committed generation."""
    row = committed(spark, root).orderBy(F.col("step").desc()).limit(1).collect()
    return spark.read.parquet(f"{root}/{row[0].folder}") if row else None


def retained(generations: DataFrame, step: str, newest: int, protected: list[int] = ()) -> DataFrame:
    """Generations with whether they stay: the newest n, and those protected."""
    hid = prefix(generations)
    top = generations.select(F.col(step).alias(f"{hid}s")).distinct().orderBy(F.col(f"{hid}s").desc()).limit(newest)
    return generations.join(F.broadcast(top), F.col(step) == F.col(f"{hid}s"), "left").withColumn("kept", F.col(f"{hid}s").isNotNull() | F.col(step).isin(*protected) if protected else F.col(f"{hid}s").isNotNull()).drop(f"{hid}s")


def cache_writes(requests: DataFrame, key: str, rank: str, present: DataFrame) -> DataFrame:
    """What to publish: keys that the cache lacks, each by its least rank."""
    return requests.join(present.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.min(rank).alias("publisher"))


def shard_numbers(df: DataFrame, order: list[str], size: str, most: int) -> DataFrame:
    """Shard of each row when shards are cut by running size: the number of whole limits before the row."""
    hid = prefix(df)
    from ..operators.sampling import running_total

    return running_total(df, order, size, f"{hid}before").withColumn("shard", F.floor(F.col(f"{hid}before") / most).cast("long")).drop(f"{hid}before")


def write_shards(df: DataFrame, order: list[str], size: str, most: int, path: str) -> DataFrame:
    """Write rows in shards of about ``most`` units and an index of them: (shard, name, rows, units), which is returned.

    Rows of a shard share a folder named ``shard=i``; the index is written last, so that a reader
    who goes by it sees complete shards only. Names say which of how many (``bounded_name``).
    """
    from ..tables import saved

    rows = saved(shard_numbers(df, order, size, most))
    rows.repartition("shard").sortWithinPartitions("shard", *order).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/data")
    index = rows.groupBy("shard").agg(F.count("*").alias("rows"), F.sum(size).alias("units"))
    n = F.lit(index.agg(F.coalesce(F.max("shard") + 1, F.lit(0)).alias("n")).first().n)
    index = index.select("shard", bounded_name("shard", n).alias("name"), "rows", "units")
    index.coalesce(1).write.mode("overwrite").json(f"{path}/index")
    return df.sparkSession.read.schema(index.schema).json(f"{path}/index")


def write_file(spark: SparkSession, text: str, path: str) -> None:
    """Write a small text as one file, whole or not at all: under another name first, then renamed over the old one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    whole, part = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.part"))
    fs = whole.getFileSystem(conf)
    stream = fs.create(part, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf)
    over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = over
    context.rename(part, whole, options)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of every file below a folder, in any store that Spark reads.

    Spark hands a file on as one value, so a file of 2 GB or more fails; provenance files are code and recipes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def unexpected(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Expected rows whose actual value differs or is absent."""
    hid = prefix(actual, expected)
    a = actual.select(F.col(key).alias(f"{hid}k"), F.col(value).alias("actual"))
    return expected.join(a, F.col(key) == F.col(f"{hid}k"), "left").where(~F.col(value).eqNullSafe(F.col("actual"))).drop(f"{hid}k")


def routed(metrics: DataFrame, name: str, value: str, step: str, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(history of numbers with shifted steps, latest text of each name) from values given as text."""
    number = F.expr(f"try_cast({value} as double)")
    history = metrics.where(number.isNotNull()).select((F.col(step) + offset).alias("step"), F.col(name).alias("name"), number.alias("value"))
    summary = metrics.where(number.isNull()).groupBy(F.col(name).alias("name")).agg(F.max_by(value, step).alias("value"))
    return history, summary


def scalar_json(df: DataFrame) -> Column:
    """One JSON text of a row's scalar columns: text, integers, floats and flags."""
    return F.to_json(F.struct(*[F.col(c) for c, t in df.dtypes if t in ("string", "int", "bigint", "smallint", "tinyint", "float", "double", "boolean")]))


def acknowledgements(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests with their outcome: done with its status, or pending."""
    return requests.join(done, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def bounded_name(i: C, n: C) -> Column:
    """Name of shard i of n."""
    return F.format_string("%05d-of-%05d", col(i) + 1, col(n))
