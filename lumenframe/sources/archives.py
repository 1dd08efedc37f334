"""Provenance of files of any size: digests by ranges of bytes, and archives with an index.

A file is read by ranges of ``RANGE`` bytes, many tasks a file; its digest is that of its ranges' digests, in order, so no
task and no row holds a whole file. An archive is a set of parts, each a run of whole files, and an index that says
where in which part a file lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import running_total
from ..tables import saved
from .ranged import Ranged, listed, place

RANGE, PIECE = 64 << 20, 1 << 20


def files_below(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, bytes) of the files under a folder; the driver lists names, it reads nothing."""
    return spark.createDataFrame(listed(path, suffixes), "path string, bytes long")


def range_digests(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, start, n, sha256) of every range of every file; an empty file has one empty range."""
    import pyarrow as pa

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, start, n in zip(*(b.column(c).to_pylist() for c in ("path", "start", "n")), strict=True):
                h = hashlib.sha256()
                with Ranged(path) as f:
                    for at in range(start, start + n, PIECE):
                        h.update(f.range(at, min(PIECE, start + n - at)))
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("path", "start", "n")), pa.array(out, pa.string())], names=["path", "start", "n", "sha256"])

    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(size).cast("long"))
    ranges = files.select("path", "bytes", F.explode(starts).alias("start")).select("path", "start", F.least(F.lit(size), F.col("bytes") - F.col("start")).cast("long").alias("n"))
    return ranges.repartition("path", "start").mapInArrow(read, "path string, start long, n long, sha256 string")


def file_trees(ranges: DataFrame) -> DataFrame:
    """(path, bytes, ranges, root) of each file: ``root`` is the digest of its ranges' digests, 64 letters each, in order."""
    leaves = F.transform(F.array_sort(F.collect_list(F.struct("start", "sha256"))), lambda x: x["sha256"])
    return ranges.groupBy("path").agg(F.sum("n").alias("bytes"), F.count("*").alias("ranges"), F.sha2(F.array_join(leaves, "").cast("binary"), 256).alias("root"))


def write_archive(files: DataFrame, folder: str, part_bytes: int = 1 << 30) -> DataFrame:
    """Write files (path, bytes) one behind the other into parts of about ``part_bytes``; the index (path, part, offset, bytes, sha256), by which alone readers go.

    A part is written by one task, in pieces, under another name first; a file that is larger than a part has one of its own size. The
    index is returned once it is written.
    """
    import uuid

    import pyarrow as pa

    def write(t: pa.Table) -> pa.Table:
        t = t.sort_by("path")
        part = t.column("part")[0].as_py()
        fs, at = place(folder)
        fs.create_dir(at, recursive=True)
        name, partial = f"{at}/part-{part:06d}", f"{at}/_part-{part:06d}.{uuid.uuid4().hex}"
        offset, rows = 0, []
        with fs.open_output_stream(partial) as out:
            for path in t.column("path").to_pylist():
                h, n = hashlib.sha256(), 0
                with Ranged(path) as f:
                    while piece := f.read(PIECE):
                        out.write(piece)
                        h.update(piece)
                        n += len(piece)
                rows.append((path, part, offset, n, h.hexdigest()))
                offset += n
        fs.move(partial, name)
        return pa.table(list(map(list, zip(*rows, strict=True))), schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    parts = running_total(files.select("path", "bytes"), ["path"], "bytes").select("path", F.floor(F.col("before") / part_bytes).cast("long").alias("part"))
    index = saved(parts.groupBy("part").applyInArrow(write, "path string, part long, offset long, bytes long, sha256 string"))
    index.coalesce(1).write.mode("overwrite").json(f"{folder}/_index")
    return files.sparkSession.read.schema("path string, part long, offset long, bytes long, sha256 string").json(f"{folder}/_index")


def archived(spark: SparkSession, folder: str, path: str) -> bytes:
    """The bytes of one file of an archive, by its index: a range of one part."""
    r = spark.read.schema("path string, part long, offset long, bytes long").json(f"{folder}/_index").where(F.col("path") == path).first()
    if r is None:
        raise KeyError(path)
    with Ranged(f"{folder}/part-{r.part:06d}") as f:
        return f.range(r.offset, r.bytes)
