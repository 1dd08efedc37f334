"""Manifest scans: formats, physical row ids, heavy columns, file metadata, paths."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import C, col, strip
from ..tables import prefix, unused
from .ranged import Ranged, listed


def read_manifest(spark: SparkSession, path: str, schema: str | None = None, heavy: list[str] = ()) -> DataFrame:
    """A manifest by its suffix: Parquet, JSON lines (blank lines skipped) or one JSON array; without its heavy columns.

    Dropping columns here prunes them from the scan. Other suffixes raise ValueError.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith((".parquet", ".pq")):
        df = reader.parquet(path)
    elif path.endswith(".jsonl"):
        df = reader.json(path)
    elif path.endswith(".json"):
        df = reader.option("multiLine", True).json(path)
    elif path.endswith(".csv"):
        df = reader.option("header", True).csv(path)
    else:
        raise ValueError(f"no reader for {path}")
    return df.drop(*heavy)


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add the file and the physical row number of each row, taken before any filter."""
    return df.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias(name))


def numbered_scan(spark: SparkSession, path: str, columns: list[str], name: str = "row_id") -> DataFrame:
    """The columns and the physical number of each row in the whole table: its files follow one another by their paths, from 0.

    A file's first number is the rows of the files before it, counted in a scan of no columns; no row is sorted or moved. The driver holds a number a file.
    """
    df = spark.read.parquet(path)
    file, row, start = unused(df, "file", "row", "start")
    first, before = [], 0
    for f in sorted(df.groupBy(F.col("_metadata.file_path").alias(file)).count().collect()):
        first.append((f[0], before))
        before += f[1]
    starts = F.broadcast(spark.createDataFrame(first, f"`{file}` string, `{start}` long"))
    rows = df.select(*columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return rows.join(starts, file).select(*columns, (F.col(start) + F.col(row)).alias(name))


def row_groups(spark: SparkSession, path: str, files_per_task: int = 64) -> DataFrame:
    """(path, file_name, row_group, first_row, n_rows) of every row group under a path, from the footers, which tasks read.

    ``first_row`` counts inside the file, as ``with_row_ids`` does.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                with Ranged(file) as f:
                    meta = pq.read_metadata(f)
                n = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
                first = [sum(n[:i]) for i in range(len(n))]
                yield pa.record_batch([[file] * len(n), [file.rsplit("/", 1)[-1]] * len(n), pa.array(range(len(n)), pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64())], names=["path", "file_name", "row_group", "first_row", "n_rows"])

    files = [(p,) for p, _ in listed(path, (".parquet", ".pq"))]
    parts = max(1, -(-len(files) // files_per_task))
    return spark.createDataFrame(files, "path string").repartition(parts).mapInArrow(footers, "path string, file_name string, row_group long, first_row long, n_rows long")


def rows_at(spark: SparkSession, path: str, wanted: DataFrame, columns: list[str], file: str = "file_name", row: str = "row_id") -> DataFrame:
    """(file, row, columns) of the wanted physical rows: a scan that reads their row groups and no others, and of these the columns asked for.

    Row ids become (file, row group, place) by a join with the footers; wanted rows are then dealt by row group, so that each
    group is read by one task, once; the pages of one group at a time are in memory. Wanted rows that repeat come once; files and rows that are not there, and nulls, give nothing.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = spark.read.parquet(path).select(*columns).schema
    groups = row_groups(spark, path)
    # a file's groups are a short list, looked through in place
    table = groups.groupBy("path", "file_name").agg(F.array_sort(F.collect_list(F.struct("first_row", "n_rows", "row_group"))).alias("groups"))
    asked = wanted.select(F.col(file).alias("asked_file"), F.col(row).cast("long").alias("asked_row")).where("asked_row >= 0").distinct()
    found = asked.join(table, F.col("asked_file") == F.col("file_name")).withColumn("g", F.get(F.filter("groups", lambda g: (F.col("asked_row") >= g["first_row"]) & (F.col("asked_row") < g["first_row"] + g["n_rows"])), F.lit(0))).where("g IS NOT NULL")
    lists = found.groupBy("path", "asked_file", F.col("g.row_group").alias("row_group"), F.col("g.first_row").alias("first_row")).agg(F.array_sort(F.collect_list("asked_row")).alias("rows"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with Ranged(r["path"]) as f, pq.ParquetFile(f, pre_buffer=False) as part:
                    places = pa.array([x - r["first_row"] for x in r["rows"]], pa.int64())
                    t = part.read_row_group(r["row_group"], columns=columns).select(columns).take(places)
                names = pa.array([r["asked_file"]] * t.num_rows, pa.string())
                yield from t.add_column(0, row, pa.array(r["rows"], pa.int64())).add_column(0, file, names).to_batches()

    out = f"`{file}` string, `{row}` long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return lists.repartition("path", "row_group").mapInArrow(fetch, out)


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Key-value metadata of a Parquet file's footer: (path, key, value); of a folder, that of its first data file.

    Spark's reader does not show it. Only the footer, a few KB, is read, through Spark's own
    file systems, so any store that Spark reads will do.
    """
    import io
    import struct

    import pyarrow.parquet as pq

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    status = fs.getFileStatus(at)
    if status.isDirectory():
        inside = [x for x in fs.listStatus(at) if not x.getPath().getName().startswith(("_", "."))]
        status = min(inside, key=lambda x: x.getPath().getName())

    def tail(n: int) -> bytes:
        stream = fs.open(status.getPath())
        try:
            stream.seek(status.getLen() - n)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    size = struct.unpack("<I", tail(8)[:4])[0]
    meta = pq.read_metadata(io.BytesIO(b"PAR1" + tail(size + 8))).metadata or {}
    name = status.getPath().toString()
    rows = [(name, k.decode(), v.decode("utf-8", "replace")) for k, v in meta.items() if k != b"ARROW:schema"]
    return spark.createDataFrame(rows, "path string, key string, value string")


def json_metadata(spark: SparkSession, path: str, *spellings: str) -> dict | None:
    """The first of the given metadata keys that is there, as JSON."""
    found = {r.key: r.value for r in file_metadata(spark, path).where(F.col("key").isin(*spellings)).select("key", "value").collect()}
    return next((json.loads(found[s]) for s in spellings if s in found), None)


def camera_paths(df: DataFrame, template: C, cameras: C, name: str = "path") -> DataFrame:
    """One row per camera with its path from a printf-style template such as ``cam_%06d.mp4``."""
    out = df.where(col(cameras) > 0).withColumn("camera", F.explode(F.sequence(F.lit(0), col(cameras).cast("int") - 1)))
    return out.withColumn(name, F.format_string(template, "camera") if isinstance(template, str) and "%" in template else F.expr(f"format_string({template}, camera)"))


def resolved_path(path: C, root: C, suffix: str = ".mp4") -> Column:
    """An absolute path as it is, a relative one under its root; the suffix is added where there is none; blank gives null."""
    p = strip(path)
    whole = F.when(p.startswith("/") | p.contains("://"), p).otherwise(F.concat_ws("/", F.regexp_replace(col(root), "/+$", ""), p))
    named = F.when(F.regexp_like(whole, F.lit(r"\.[A-Za-z0-9]+$")) | whole.endswith("/"), whole).otherwise(F.concat(whole, F.lit(suffix)))
    return F.when(F.coalesce(p == "", F.lit(True)), F.lit(None)).otherwise(named)


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files under a folder by parent: (parent, files), sorted; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return found.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list(F.substring_index("path", "/", -1))).alias("files"))


def first_of_folder(df: DataFrame, path: str, files: DataFrame, name: str = "file", missing: str = "error") -> DataFrame:
    """Add the file that each path stands for: itself, or with ``.mp4`` if that is what there is, or the first of a folder.

    ``files`` has (parent, files) as ``listing`` gives it. Paths without a file fail, when run, or
    give null (``missing="null"``). The listing is exploded and joined, so it may be large.
    """
    hid = prefix(df, files)
    each = files.select("parent", F.explode("files").alias("f")).select(F.concat_ws("/", "parent", "f").alias(f"{hid}there"))
    folders = files.select(F.col("parent").alias(f"{hid}folder"), F.concat_ws("/", "parent", F.get("files", F.lit(0))).alias(f"{hid}first"))
    p = F.regexp_replace(col(path), "/+$", "")
    out = df.withColumn(f"{hid}p", p).join(each.withColumn(f"{hid}own", F.lit(True)), F.col(f"{hid}p") == F.col(f"{hid}there"), "left").drop(f"{hid}there")
    out = out.withColumn(f"{hid}q", F.concat(f"{hid}p", F.lit(".mp4"))).join(each.withColumn(f"{hid}named", F.lit(True)), F.col(f"{hid}q") == F.col(f"{hid}there"), "left").drop(f"{hid}there")
    out = out.join(folders, F.col(f"{hid}p") == F.col(f"{hid}folder"), "left")
    found = F.when(F.col(f"{hid}own"), F.col(f"{hid}p")).when(F.col(f"{hid}named"), F.col(f"{hid}q")).otherwise(F.col(f"{hid}first"))
    if missing == "error":
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no file for "), F.coalesce(col(path), F.lit("null")))).cast("string"))
    return out.withColumn(name, found).select(*df.columns, name)


def camera_yaml(spark: SparkSession, path: str) -> DataFrame:
    """Matrices of OpenCV-style camera files: (path, name, rows, cols, data), one row per matrix.

    The files are small text; they are parsed with expressions, so no Python runs on them.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = r"(?m)^\s*(\w+)\s*:\s*!!opencv-matrix\s+rows\s*:\s*\d+\s+cols\s*:\s*\d+\s+dt\s*:\s*\w+\s+data\s*:\s*\[[^\]]*\]"
    each = text.select("path", F.explode(F.regexp_extract_all("value", F.lit(head), F.lit(0))).alias("m"))
    number = lambda k: F.regexp_extract("m", rf"{k}\s*:\s*(\d+)", 1).cast("int")
    data = F.split(F.regexp_replace(F.regexp_extract("m", r"data\s*:\s*\[([^\]]*)\]", 1), r"\s+", ""), ",")
    return each.select("path", F.regexp_extract("m", r"^\s*(\w+)", 1).alias("name"), number("rows").alias("rows"), number("cols").alias("cols"), F.transform(F.filter(data, lambda x: x != ""), lambda x: x.cast("double")).alias("data"))


def requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sound, rejected with a reason) views of request files: a prompt, a positive rate, and views with an image and a camera track."""
    schema = "prompt string, fps double, views array<struct<image: string, camera: array<array<double>>, scale: double, prompt: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select("prompt", "fps", F.posexplode_outer("views").alias("view", "v"))
    cam = F.col("v.camera")
    bad_camera = F.coalesce(F.size(cam) < 1, F.lit(True)) | F.coalesce(F.exists(cam, lambda r: (F.size(r) != 10) | F.exists(r, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), F.lit(True))
    reason = (
        F.when(F.col("v").isNull(), "no views")
        .when(F.coalesce(strip(F.coalesce("v.prompt", "prompt")) == "", F.lit(True)), "no prompt")
        .when(~F.coalesce(F.col("fps") > 0, F.lit(False)), "fps")
        .when(F.coalesce(strip("v.image") == "", F.lit(True)), "no image")
        .when(bad_camera, "camera")
        .when(~F.coalesce(F.coalesce(F.col("v.scale"), F.lit(1.0)) > 0, F.lit(False)), "scale")
    )
    out = rows.select(F.coalesce("v.prompt", "prompt").alias("prompt"), "fps", F.col("view").cast("long").alias("view"), F.col("v.image").alias("image"), F.col("v.camera").alias("camera"), F.coalesce("v.scale", F.lit(1.0)).alias("scale"), reason.alias("reason"))
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def index_faults(index: DataFrame, found: DataFrame) -> DataFrame:
    """Faults of an indexed shard set: (key, fault), from index (key, shard) and keys found in files (key, shard)."""
    n = found.groupBy("key").agg(F.count("*").alias("n"), F.min("shard").alias("there"))
    both = index.join(n, "key", "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("shard").isNull(), "extra").when(F.col("n") > 1, "several").when(F.col("shard") != F.col("there"), "misplaced")
    return both.select("key", fault.alias("fault")).where("fault is not null")


_SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(kind: str):
    """Register a builder (spark, config) -> DataFrame under a type name."""

    def add(f):
        _SOURCES[kind] = f
        return f

    return add


def create_source(spark: SparkSession, config: dict) -> DataFrame:
    """Build a source by its ``type``. ``concat`` builds its ``sources``, each with the shared fields it does not set."""
    kind = config.get("type")
    if kind == "concat":
        from ..operators.sets import union_sources

        shared = {k: v for k, v in config.items() if k not in ("type", "sources")}
        return union_sources({s.get("name", f"source{i}"): create_source(spark, {**shared, **s}) for i, s in enumerate(config["sources"])})
    if kind not in _SOURCES:
        raise ValueError(f"no source of type {kind!r}; known: {sorted(_SOURCES)}")
    return _SOURCES[kind](spark, config)


@source("manifest")
def _manifest(spark: SparkSession, config: dict) -> DataFrame:
    return read_manifest(spark, config["path"], config.get("schema"), config.get("heavy", []))


@source("table")
def _table(spark: SparkSession, config: dict) -> DataFrame:
    df = spark.read.parquet(config["path"])
    return df.select(*config["columns"]) if config.get("columns") else df
