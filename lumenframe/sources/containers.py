"""The index of video containers (ISO base media files), without their payload.

A file is a list of boxes, each with its size in front. The reader goes from box to box, 16 bytes each, to
the one that holds the index (``moov``), wherever it stands, and reads that box alone: some MB of a file of many GB.
It is a Python data source: Spark gets the files, by bounded groups, as its partitions, and ranges are read in its
tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ranged import Ranged, listed

FORMAT = "container_index"
SCHEMA = (
    "path string, bytes long, bytes_read long, width int, height int, timescale long, duration double, n_frames long, frame_ticks long, fps double, "
    "keyframes array<long>, keyframe_ticks array<long>, fault string"
)
#: Files that a task reads, and the largest index that it takes into memory.
FILES, MOST_INDEX = 64, 1 << 30


def top_boxes(f: Ranged) -> Iterator[tuple[bytes, int, int]]:
    """(type, start of the payload, end) of a file's own boxes; a size of 1 means that 64 bits follow, 0 the rest of the file."""
    at = 0
    while at + 8 <= f.length:
        head = f.range(at, 16)
        size, skip = int.from_bytes(head[:4]), 8
        if size == 1 and len(head) == 16:
            size, skip = int.from_bytes(head[8:]), 16
        elif size == 0:
            size = f.length - at
        if size < skip:
            raise ValueError("broken box size")
        yield head[4:8], at + skip, min(at + size, f.length)
        at += size


def boxes(view: memoryview) -> dict[bytes, list[memoryview]]:
    """The boxes inside a box, by type."""
    out: dict[bytes, list[memoryview]] = {}
    while len(view) >= 8:
        size, skip = int.from_bytes(view[:4]), 8
        if size == 1:
            size, skip = int.from_bytes(view[8:16]), 16
        elif size == 0:
            size = len(view)
        if not skip <= size <= len(view):
            raise ValueError("broken box size")
        out.setdefault(bytes(view[4:8]), []).append(view[skip:size])
        view = view[size:]
    return out


def inner(view: memoryview, *path: bytes) -> memoryview | None:
    """The first box down a path of types, each the first of its kind."""
    for name in path:
        found = boxes(view).get(name)
        if not found:
            return None
        view = found[0]
    return view


def counted(view: memoryview | None, width: int) -> np.ndarray:
    """The rows of a table box: version and flags, a count, then rows of ``width`` 32-bit numbers."""
    if view is None or len(view) < 8:
        raise ValueError("a table is missing")
    n = int.from_bytes(view[4:8])
    if len(view) < 8 + 4 * width * n:
        raise ValueError("a table is cut off")
    return np.frombuffer(view, ">u4", n * width, 8).astype(np.int64).reshape(n, width)


def index_of(f: Ranged) -> dict:
    """What the index says of the first video track.

    Samples without length at the end of the track are left out, as no decoder gives a frame for them; the frame
    rate is that of the longest run of equal sample lengths; a track without a table of keyframes has none but keyframes.
    """
    found = next(((a, b) for kind, a, b in top_boxes(f) if kind == b"moov"), None)
    if found is None:
        raise ValueError("no index in the file")
    if found[1] - found[0] > MOST_INDEX:
        raise ValueError("the index is too large")
    tracks = boxes(memoryview(f.range(found[0], found[1] - found[0]))).get(b"trak", [])
    video = next((t for t in tracks if (h := inner(t, b"mdia", b"hdlr")) is not None and h[8:12] == b"vide"), None)
    if video is None:
        raise ValueError("no video track")
    head, media, table = inner(video, b"tkhd"), inner(video, b"mdia", b"mdhd"), inner(video, b"mdia", b"minf", b"stbl")
    if head is None or media is None or table is None:
        raise ValueError("a box of the track is missing")
    width, height = (x >> 16 for x in struct.unpack(">II", head[-8:]))
    scale, length = struct.unpack(">IQ", media[20:32]) if media[0] == 1 else struct.unpack(">II", media[12:20])
    known = boxes(table)
    n, ticks = counted(known.get(b"stts", [None])[0], 2).T
    last = int(np.flatnonzero(ticks > 0)[-1]) + 1 if (ticks > 0).any() else min(1, len(ticks))
    n, ticks = n[:last], ticks[:last]
    if not len(n):
        raise ValueError("the track has no samples")
    frame = int(ticks[np.argmax(n)])
    first, start = np.cumsum(n) - n, np.cumsum(n * ticks) - n * ticks
    if b"stss" in known:
        key = counted(known[b"stss"][0], 1)[:, 0] - 1
    else:
        key = np.arange(int(n.sum()))
    run = np.maximum(np.searchsorted(first, key, "right") - 1, 0)
    at = start[run] + (key - first[run]) * ticks[run]
    own = key < n.sum()
    return {
        "width": width, "height": height, "timescale": scale, "duration": length / scale if scale else 0.0, "n_frames": int(n.sum()), "frame_ticks": frame,
        "fps": scale / frame if frame else 0.0, "keyframes": key[own].tolist(), "keyframe_ticks": at[own].tolist(),
    }


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffixes = tuple(s.strip() for s in options.get("suffixes", ".mp4,.mov,.m4v").split(","))
        self.files_per_task = int(options.get("filesPerTask", FILES))

    def partitions(self) -> list[InputPartition]:
        files = listed(self.path, self.suffixes)
        return [_Files(files[i : i + self.files_per_task]) for i in range(0, len(files), self.files_per_task)] or [_Files([])]

    def read(self, part: _Files) -> Iterator[tuple]:
        for path, size in part.files:
            found, fault, asked = {}, None, 0
            try:
                with Ranged(path) as f:
                    try:
                        found = index_of(f)
                    finally:
                        asked = f.asked
            except (ValueError, OSError, struct.error, IndexError) as e:
                fault = str(e)
            columns = ("width", "height", "timescale", "duration", "n_frames", "frame_ticks", "fps", "keyframes", "keyframe_ticks")
            yield (path, size, asked, *(found.get(c) for c in columns), fault)


class ContainerIndex(DataSource):
    """A row a file: its size, the bytes that were read, the index of its first video track, or what is wrong with it.

    Options: ``path``, a folder or a file; ``suffixes``, by commas; ``filesPerTask``.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def container_index(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The indices of the containers under a path."""
    spark.dataSource.register(ContainerIndex)
    return spark.read.format(FORMAT).options(**options).load(path)


def container(width: int, height: int, timescale: int, runs: list[tuple[int, int]], keyframes: list[int] | None, payload: int, index_first: bool = False, wide: bool = False) -> Iterator[bytes]:
    """A container with an index and a payload of zeros, in pieces: for tests, and to try a pipeline without video."""

    def box(kind: bytes, *inside: bytes) -> bytes:
        data = b"".join(inside)
        return struct.pack(">I", len(data) + 8) + kind + data

    def table(kind: bytes, rows: list[tuple[int, ...]]) -> bytes:
        return box(kind, bytes(4), struct.pack(">I", len(rows)), *(struct.pack(f">{len(r)}I", *r) for r in rows))

    total = sum(n * t for n, t in runs)
    times = struct.pack(">BxxxQQIQ", 1, 0, 0, timescale, total) if wide else struct.pack(">BxxxIIII", 0, 0, 0, timescale, total)
    tables = [table(b"stts", runs), *([table(b"stss", [(k + 1,) for k in keyframes])] if keyframes is not None else [])]
    media = box(b"mdia", box(b"mdhd", times, bytes(4)), box(b"hdlr", bytes(8), b"vide", bytes(13)), box(b"minf", box(b"stbl", *tables)))
    sound = box(b"trak", box(b"mdia", box(b"hdlr", bytes(8), b"soun", bytes(13))))
    index = box(b"moov", sound, box(b"trak", box(b"tkhd", bytes(84 - 8), struct.pack(">II", width << 16, height << 16)), media))
    data = struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", payload + 16)
    yield box(b"ftyp", b"isom")
    if index_first:
        yield index
    yield data
    while payload:
        n = min(payload, 1 << 20)
        yield bytes(n)
        payload -= n
    if not index_first:
        yield index


def write_containers(rows: DataFrame, folder: str) -> int:
    """Write a container for each row (name, width, height, timescale, runs, keyframes, payload) into a folder; the number of files.

    Tasks write a file under another name first and rename it, so that a repeated task leaves whole files.
    """
    import pyarrow as pa

    from .ranged import place

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, at = place(folder)
        fs.create_dir(at, recursive=True)
        for batch in batches:
            for r in batch.to_pylist():
                partial = f"{at}/_{r['name']}.{uuid.uuid4().hex}"
                with fs.open_output_stream(partial) as f:
                    for piece in container(r["width"], r["height"], r["timescale"], [(x["n"], x["ticks"]) for x in r["runs"]], r["keyframes"], r["payload"]):
                        f.write(piece)
                fs.move(partial, f"{at}/{r['name']}")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    names = ["name", "width", "height", "timescale", "runs", "keyframes", "payload"]
    return rows.select(*names).mapInArrow(write, "n long").agg({"n": "sum"}).first()[0] or 0
