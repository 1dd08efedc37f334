"""Indices of containers, plans for fetching frames, physical rows, packed canvases."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import gather as G
from lumenframe.operators import packing as K
from lumenframe.sources import containers as C
from lumenframe.sources import manifests as M
from lumenframe.sources.ranged import Ranged


def put(path, *args, **k):
    with open(path, "wb") as f:
        for piece in C.container(*args, **k):
            f.write(piece)


@pytest.fixture(scope="module")
def clips(tmp_path_factory):
    p = tmp_path_factory.mktemp("clips")
    (p / "sub").mkdir()
    put(p / "a.mp4", 1280, 720, 12_800, [(499, 512), (1, 0)], list(range(0, 499, 48)), 3_000_000)
    put(p / "b.mov", 64, 32, 600, [(10, 25), (5, 50), (2, 25)], [0, 9, 12, 16], 10, index_first=True, wide=True)
    put(p / "sub" / "c.mp4", 16, 16, 1000, [(3, 40)], None, 0)
    put(p / "zero.mp4", 16, 16, 1000, [(2, 0), (3, 0)], [0], 0)
    (p / "cut.mp4").write_bytes((p / "a.mp4").read_bytes()[:-700])
    (p / "text.mp4").write_bytes(b"not a container at all, only text")
    (p / "empty.mp4").write_bytes(b"")
    (p / "notes.txt").write_text("x")
    return str(p)


def test_indices_of_containers(spark, clips):
    got = {r.path.rsplit("/", 1)[-1]: r for r in C.container_index(spark, clips, filesPerTask="2").collect()}
    assert set(got) == {"a.mp4", "b.mov", "c.mp4", "zero.mp4", "cut.mp4", "text.mp4", "empty.mp4"}
    a, b, c = got["a.mp4"], got["b.mov"], got["c.mp4"]
    assert (a.width, a.height, a.n_frames, a.fps, a.frame_ticks, a.timescale) == (1280, 720, 499, 25.0, 512, 12_800)
    assert a.keyframes == list(range(0, 499, 48)) and a.keyframe_ticks == [512 * k for k in a.keyframes]
    assert a.bytes > 3_000_000 and a.bytes_read < 2_000  # the index, and the heads of the boxes before it
    assert (b.n_frames, b.frame_ticks, b.fps, b.keyframe_ticks) == (17, 25, 24.0, [0, 225, 350, 525]) and b.duration == 550 / 600
    assert (c.n_frames, c.keyframes, c.keyframe_ticks) == (3, [0, 1, 2], [0, 40, 80])
    assert got["zero.mp4"].n_frames == 2 and got["zero.mp4"].fps == 0.0
    assert all(got[x].fault and got[x].n_frames is None for x in ("cut.mp4", "text.mp4", "empty.mp4")) and not a.fault


def test_a_container_of_more_than_4_gb(spark, tmp_path):
    """The payload is a hole in a sparse file; its size is in 64 bits."""
    pieces = list(C.container(32, 16, 100, [(7, 4)], [0, 3], 0))
    with open(tmp_path / "big.mp4", "wb") as f:
        f.write(pieces[0])
        f.write((1).to_bytes(4) + b"mdat" + (5_000_000_000 + 16).to_bytes(8))
        f.seek(5_000_000_000, 1)
        f.write(pieces[-1])
    r = C.container_index(spark, str(tmp_path)).first()
    assert (r.n_frames, r.keyframes, r.fault) == (7, [0, 3], None) and r.bytes > 5_000_000_000 and r.bytes_read < 2_000


def test_no_files(spark, tmp_path):
    assert C.container_index(spark, str(tmp_path)).count() == 0


def decode(frames, n, keys, seek_cost):
    """A gather frame by frame: what is decoded if the reader seeks whenever that is cheaper."""
    want = sorted({(min(max(f, -n), n - 1)) % n for f in frames})
    decoded, at = [], None
    for f in want:
        key = max(k for k in keys if k <= f)
        if at is None or (key > at and key - at - 1 > seek_cost):
            at = key - 1
            decoded.append([])
        decoded[-1] += range(at + 1, f + 1)
        at = f
    return want, decoded


@pytest.mark.parametrize("seek_cost", [0, 4])
def test_plans_equal_a_gather_frame_by_frame(spark, seek_cost):
    r = np.random.default_rng(seek_cost)
    clips, asked = [], []
    for c in range(6):
        n = int(r.integers(1, 90))
        clips.append((f"c{c}", n, 512, sorted({0, *map(int, r.integers(0, n, 6))})))
    for q in range(60):
        asked.append((q, f"c{q % 6}", [int(x) for x in r.integers(-120, 120, r.integers(1, 12))], "kept"))
    asked += [(100, "none", [1, 2], None), (101, "c0", [], None), (102, "hollow", [0], None)]
    clips.append(("hollow", 0, 512, []))
    df = spark.createDataFrame(asked, "q long, clip string, frames array<long>, n_frames string")
    wanted = G.wanted_frames(df, ["q"], "clip", "frames", spark.createDataFrame(clips, "clip string, n_frames long, frame_ticks long, keyframes array<long>"))
    plan, slots = {}, {}
    for p in G.gather_plan(wanted, ["q"], "clip", seek_cost).collect():
        plan.setdefault(p.q, {})[p.step] = (p.seek, p.last, p.n_wanted, p.n_decoded)
    for s in G.gather_slots(wanted, ["q"]).collect():
        slots[s.q, s.place] = s.slot
    index = {c: (n, k) for c, n, _, k in clips}
    for q, clip, frames, _ in asked[:60]:
        want, decoded = decode(frames, *index[clip], seek_cost)
        assert [plan[q][s] for s in sorted(plan[q])] == [(d[0], d[-1], len(set(d) & set(want)), len(d)) for d in decoded]
        n = index[clip][0]
        assert [want[slots[q, i]] for i in range(len(frames))] == [min(max(f, -n), n - 1) % n for f in frames]
    assert not set(plan) & {100, 101, 102}
    assert {(w.q, w.frame, w.keyframe) for w in wanted.where("q >= 100").collect()} == {(100, None, None), (102, None, None)}


def test_only_wanted_row_groups_are_read(spark, tmp_path, monkeypatch):
    for k in range(2):
        rows = pa.table({"i": range(k * 1000, k * 1000 + 1000), "heavy": [f"{k}-{i}" * 500 for i in range(1000)], "other": [None] * 1000})
        pq.write_table(rows, tmp_path / f"f{k}.parquet", row_group_size=100, compression="none")
    path = str(tmp_path)
    groups = M.row_groups(spark, path).collect()
    assert sorted((g.file_name, g.row_group, g.first_row, g.n_rows) for g in groups) == [(f"f{k}.parquet", i, 100 * i, 100) for k in range(2) for i in range(10)]
    wanted = [("f0.parquet", 5), ("f0.parquet", 5), ("f0.parquet", 99), ("f1.parquet", 730), ("f1.parquet", 5000), ("f1.parquet", -1), ("none", 1), (None, 1), ("f1.parquet", None)]
    df = spark.createDataFrame(wanted, "file_name string, row_id long")
    got = sorted(tuple(r) for r in M.rows_at(spark, path, df, ["heavy", "i"]).collect())
    assert got == [("f0.parquet", 5, "0-5" * 500, 5), ("f0.parquet", 99, "0-99" * 500, 99), ("f1.parquet", 730, "1-730" * 500, 1730)]
    with Ranged(f"{path}/f0.parquet") as f:  # what a group's columns cost
        pq.ParquetFile(f, pre_buffer=False).read_row_group(0, columns=["heavy", "i"])
        assert f.asked < 0.25 * f.length


def test_rows_at_of_a_scan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = M.with_row_ids(docs.select("doc_id", "_metadata"), "row_id").select("doc_id", "file_name", "row_id").where("doc_id % 3 = 0")
    got = {r.doc_id: r.text for r in M.rows_at(spark, f"{data}/documents.parquet", ids, ["doc_id", "text"]).collect()}
    assert got == {r.doc_id: r.text for r in docs.where("doc_id % 3 = 0").collect()}


def test_untiled_views_are_slices_of_a_matrix(spark):
    r = np.random.default_rng(2)
    canvas = r.normal(size=(2, 9, 7))
    layout = [(0, 1.0, 0.0, 0.0), (1, 0.5, 0.5, 0.5), (2, 0.36, 0.9, 0.8), (3, 0.5, 0.99, 0.0), (4, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame([(1, "x", canvas.ravel().tolist()), (2, "y", None)], "id long, _boxes string, canvas array<double>")
    out = K.untiled(df, "canvas", 7, 9, spark.createDataFrame(layout, "view long, scale double, x double, y double"), frames=2).collect()
    for v in [o for o in out if o.id == 1]:
        _, s, x, y = layout[v.view]
        h, w, x, y = round(9 * s), round(7 * s), round(7 * x), round(9 * y)
        want = canvas[:, y : y + h, x : x + w]
        assert (v.view_height, v.view_width) == want.shape[1:] and v.pixels == want.ravel().tolist() and v._boxes == "x"
    assert [o.pixels for o in out if o.id == 2] == [None] * 5


def test_a_long_walk_takes_linear_time(spark):
    import time

    from lumenframe.operators import partitioning as D

    def took(n):
        t = time.time()
        D.momentum_walk(spark.createDataFrame([(1, n)], "k long, n long"), ["k"], "n", 12, "n").agg(F.sum("view")).collect()
        return time.time() - t

    took(1_000)
    assert took(200_000) < 20


def test_chaotic_walks_join_nothing_and_have_tasks_for_every_core(spark):
    from lumenframe.operators import partitioning as D

    p = spark.createDataFrame([(i, 3 + i % 4) for i in range(64)], "k long, n long").coalesce(1).withColumn("o", F.array(F.lit(0), F.lit(5)))
    out = D.chaotic_walks(p, ["k"], "n", 12, "n", "o", 0.0)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    # without chaos every view follows the shared walk, its offset apart
    shared = {(r.k, r.step): (r.view, r.frame) for r in D.momentum_walk(p.drop("o"), ["k"], "n", 12, "n").collect()}
    rows = out.collect()
    assert len(rows) == 2 * len(shared)
    assert all((r.camera, r.frame) == ((shared[r.k, r.step][0] + 5 * r.place) % 12, shared[r.k, r.step][1]) for r in rows)


def test_walks_are_those_of_a_loop(spark):
    from lumenframe.functions.scalar import normal_draw
    from lumenframe.operators import partitioning as D

    df = spark.createDataFrame([(1, 50), (2, 1), (3, 0), (4, None), (5, 47)], "step long, n long")
    got = {}
    for r in D.momentum_walk(df.withColumnRenamed("step", "k"), ["k"], "n", 12, F.lit(30), frame_speed=(-2.0, 2.0), frame_push=(-2.0, 2.0), hold=7).collect():
        got.setdefault(r.k, {})[r.step] = (r.view, r.frame)
    assert {k: len(v) for k, v in got.items()} == {1: 50, 2: 1, 5: 47}
    for k in (1, 5):
        pushes = spark.range(10).select("id", (normal_draw(F.lit(k), "id", salt="walk") * (2 / 6)).alias("v"), (normal_draw(F.lit(k), "id", salt="walk/frames") * (4 / 6)).alias("f")).orderBy("id").collect()
        view, frame = got[k][0]
        v = f = 0.0
        for i in range(1, len(got[k])):
            p = pushes[(i - 1) // 7]
            v, f = (min(max((a + b) * 0.8, -3.0), 3.0) for a, b in ((v, p.v), (f, p.f)))
            view, frame = (view + round(v)) % 12, (frame + round(min(max(f, -2.0), 2.0))) % 30
            assert got[k][i] == (view, frame)
