"""Truth tables and properties of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import scalar as X
from lumenframe.operators import filters, joins, packing, partitioning, sampling, sets, stats, timebase, visibility


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_short_clips_cover_every_frame_once(spark):
    df = spark.createDataFrame([(0, 297), (1, 77), (2, 10), (3, 150)], "view long, n long")
    got = values(filters.short_clips(df, "n").orderBy("clip", "view"), "clip", "view", "start", "stop")
    assert {c: [v for k, v, _, _ in got if k == c] for c in range(4)} == {0: [0, 1, 2, 3], 1: [0, 3], 2: [0], 3: [0]}
    assert sum(b - a for *_, a, b in got) == 297 + 77 + 10 + 150


def test_short_clips_have_no_cap(spark):
    df = spark.createDataFrame([(0, 128_657)], "view long, n long")
    got = values(filters.short_clips(df, "n").orderBy("clip"), "clip", "start", "stop")
    assert got == [(i, 77 * i, min(77 * (i + 1), 128_657)) for i in range(1671)]


def test_temporal_layout_of_77_frames(spark):
    df = timebase.temporal_layout(spark.createDataFrame([(77,)], "n long"), "n").cache()
    assert df.count() == 27 and df.where("valid").count() == 23
    assert df.where("valid").agg(F.max("camera_frame")).first()[0] == 76
    assert values(spark.createDataFrame([(77,), (1,), (5,), (22,)], "n long"), timebase.padded_frames("n")) == [(90,), (1,), (5,), (22,)]


@pytest.mark.parametrize("n", [1, 2, 5, 17, 22, 39, 77, 90, 297])
def test_padding_never_shortens(spark, n):
    df = spark.createDataFrame([(n,)], "n long")
    assert values(df, timebase.padded_frames("n"))[0][0] >= n
    assert timebase.temporal_layout(df, "n").agg(F.max("camera_frame")).first()[0] == n - 1


def test_source_blocks_of_22_frames(spark):
    df = timebase.temporal_layout(spark.createDataFrame([(22,)], "n long"), "n").withColumn("b", timebase.source_block("start", F.lit(5)))
    df = df.withColumn("g", F.lit(0)).withColumn("c", timebase.clamped_block("b", "valid", ["g"]))
    assert [r.c for r in df.orderBy("latent").collect()] == [0, 0, 0, 0, 0, 1, 1]


def test_caption_majority_excludes_ties(spark):
    frames, ends = [0, 17, 27, 37, 48, 57], [17, 27, 37, 48, 57, 77]
    blocks = spark.createDataFrame([("a", i, a, b) for i, (a, b) in enumerate(zip(frames, ends))], "d string, block long, start long, stop long")
    windows = spark.createDataFrame([("a", j, max(0, 20 * j - 3), min(77, 20 * (j + 1) - 3)) for j in range(4)], "d string, motion long, left long, right long")
    got = values(joins.overlap_join(blocks, windows, ["d"]).where("motion is not null").orderBy("block"), "block", "motion")
    assert got == [(0, 0), (3, 2), (5, 3)]
    for length, hit in ((10, None), (11, 2)):
        one = spark.createDataFrame([("a", 37, 37 + length)], "d string, start long, stop long")
        assert values(joins.overlap_join(one, windows, ["d"]), "motion") == [(hit,)]


def test_visibility_truth_table(spark):
    kinds, chunks, scopes = [0, 0, 0, 1, 1, 2, 2, 1], [-1, 0, 1, 0, 1, 0, 1, 0], [-1, 0, 0, 0, 0, 0, 0, 1]
    t = spark.createDataFrame([(i, k, c, s, True) for i, (k, c, s) in enumerate(zip(kinds, chunks, scopes))], "pos long, kind long, chunk long, scope long, active boolean")

    def seen(**how):
        q, k = (t.select(*[F.col(c).alias(f"{p}_{c}") for c in t.columns]) for p in "qk")
        out = {i: set() for i in range(8)}
        for r in q.join(k, visibility.visible("q", "k", **how)).select("q_pos", "k_pos").collect():
            out[r.q_pos].add(r.k_pos)
        return out

    s = seen()
    assert s[0] == {0}
    assert {0, 1, 5} <= s[5] and not s[5] & {2, 3, 4, 6}
    assert 3 in s[6] and not s[6] & {4, 5}
    assert 7 not in s[3] and 3 not in s[7]
    crossed = seen(cross_view=True)
    assert 7 in crossed[3] and 3 in crossed[7]


def test_inactive_tokens_see_only_themselves(spark):
    t = spark.createDataFrame([("d", 1, 0, -1, True), ("d", 1, 0, -1, False)], "d string, kind long, chunk long, scope long, active boolean")
    assert values(visibility.visible_counts(t, ["d"]), "tokens", "pairs") == [(1, 2)]


def test_runtime_shapes(spark):
    table = {"5x33": "5x28", "3x12": "2x12", "9x21": "9x18", "12x7": "10x7", "4x6": 11}
    df = spark.createDataFrame([(5, 33, False), (3, 12, False), (9, 21, True), (12, 7, False), (1, 7, False), (4, 6, False)], "v long, g long, iso boolean")
    got = {(r.v, r.g): (r.rt_views, r.rt_latents) for r in filters.runtime_shape(df, "v", "g", table, "iso", 8).collect()}
    assert got == {(5, 33): (5, 28), (3, 12): (2, 12), (9, 21): (9, 18), (12, 7): (8, 7), (1, 7): (1, 7), (4, 6): (4, 6)}


def test_rates(spark):
    got = {r.src_fps: (r.model_fps, r.snapped_fps) for r in timebase.rate_table(spark, 16, [25, 30, 60, 15, 32, 26.8, 20]).collect()}
    assert got == {25: (16, 24), 30: (15, 30), 60: (15, 60), 15: (16, 16), 32: (16, 32), 26.8: (16, 24), 20: (16, 20)}


def test_paths(spark):
    df = spark.createDataFrame([("a//b/./c/../d",), ("/../a/",), ("..",), ("./",), ("a/../..",)], "p string")
    assert [r[0] for r in values(df, X.normal_path("p"))] == ["a/b/d", "/a", "..", ".", ".."]
    df = spark.createDataFrame([("dir/x.tar.gz",), (".hidden",), ("plain",)], "p string")
    assert [r[0] for r in values(df, X.stem("p"))] == ["x.tar", ".hidden", "plain"]


def test_complete_paths(spark):
    df = spark.createDataFrame([(["a", "b"], 2), (["a", " "], 2), (["a"], 2), (["a", "b/"], 2), (["a", None], 1), (None, 1)], "p array<string>, n long")
    assert [r[0] for r in values(df, filters.complete_paths("p", "n"))] == [True, False, False, False, True, False]
    nested = spark.createDataFrame([([["a"], ["b", "c"]], 2), ([["a"], []], 2), ([["a"], None], 2)], "p array<array<string>>, n long")
    assert [r[0] for r in values(nested, filters.complete_paths("p", "n", nested=True))] == [True, False, False]


def test_half_even_and_wrap(spark):
    df = spark.createDataFrame([(0.5, -1), (1.5, 7), (2.5, 0), (-0.5, -8)], "x double, i long")
    assert values(df, X.half_even("x"), X.wrap("i", 7)) == [(0, 6), (2, 0), (2, 0), (0, 6)]
    big = spark.createDataFrame([(7540113804746346429, 4660046610375530309), (9007199254740993, 3), (2**62, 2**40), (0, 5)], "a long, b long")
    assert [r[0] for r in values(big, X.gcd("a", "b"))] == [math.gcd(7540113804746346429, 4660046610375530309), 3 if 9007199254740993 % 3 == 0 else 1, 2**40, 5]
    assert [r[0] for r in values(big.where("b = 3"), X.lcm("a", "b"))][0] == math.lcm(9007199254740993, 3)
    assert values(big.limit(1), X.linspace_index(F.lit(2**53 + 1), F.lit(3).cast("long"), F.lit(3).cast("long"))) == [(2**53 + 1,)]
    assert values(df.limit(1), X.lcm(F.lit(12), F.lit(8)), X.lcm(F.lit(0), F.lit(8))) == [(24, 0)]


def test_geometry_round_trip(spark):
    df = spark.createDataFrame([(0.3, -0.2, 0.5)], "x double, y double, z double").withColumn("r", X.rodrigues("x", "y", "z"))
    df = df.withColumn("t", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).withColumn("c", X.camera_centre(F.col("r"), F.col("t")))
    back = df.select(X.mat_vec(F.col("r"), F.col("c")).alias("v"), X.mat_mul(F.col("r"), X.transposed(F.col("r"))).alias("i")).first()
    assert [round(a, 9) for a in back.v] == [-1, -2, -3]
    assert [round(a, 9) for a in back.i] == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_world_lock_moves_the_first_pose_to_the_target(spark):
    df = spark.createDataFrame([(0.3, -0.2, 0.5)], "x double, y double, z double").withColumn("r", X.rodrigues("x", "y", "z"))
    df = df.withColumn("t", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    r, t = X.world_locked(F.col("r"), F.col("t"), F.col("r"), F.col("t"), eye)
    got = df.select(r.alias("r"), t.alias("t")).first()
    assert [round(a, 9) for a in got.r] == [1, 0, 0, 0, 1, 0, 0, 0, 1] and [round(a, 9) for a in got.t] == [0, 0, 0]


def test_numbering_is_total_and_dense(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = values(sampling.numbered(df, ["k"], "n", parts=5), "k", "n")
    assert sorted(got) == [(i, i) for i in range(1000)]


def test_shards_are_a_partition(spark):
    df = spark.range(100)
    parts = [sorted(r.id for r in sampling.strided_shard(df, ["id"], g, 7).collect()) for g in range(7)]
    assert sorted(sum(parts, [])) == list(range(100)) and parts[3][:3] == [3, 10, 17]


def test_byte_budget_splits_at_a_token(spark):
    df = spark.createDataFrame([("s", 1, 10, 4), ("s", 2, 10, 4), ("s", 3, 4, 4), ("t", 1, 5, 1), ("t", 2, 4, 4), ("t", 3, 0, 4)], "s string, o long, n long, b long")
    got = {(r.s, r.o): (r.kept, r.moved) for r in visibility.byte_budget(df.where("s = 's'"), ["s"], "o", "n", "b", 30).collect()}
    assert got == {("s", 3): (4, 0), ("s", 2): (3, 7), ("s", 1): (0, 10)}
    # what a segment asks for in vain is not used up: smaller tokens of an older one still fit
    got = {r.o: (r.kept, r.moved) for r in visibility.byte_budget(df.where("s = 't'"), ["s"], "o", "n", "b", 10).collect()}
    assert got == {3: (0, 0), 2: (2, 2), 1: (2, 3)}


def test_history_keeps_whole_chunks(spark):
    df = spark.createDataFrame([("a", c, v) for c in range(4) for v in range(3)] + [("b", 0, -1), ("b", 7, 0)], "d string, chunk long, scope long")
    kept = lambda **how: sorted(values(visibility.kept_history(df, ["d"], "chunk", 1, 1, **how), "d", "chunk", "scope"))
    assert kept() == [("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("a", 3, 0), ("a", 3, 1), ("a", 3, 2), ("b", 0, -1), ("b", 7, 0)]
    assert kept(scope="scope", sink_scope_zero=True) == [("a", 0, 0), ("a", 3, 0), ("a", 3, 1), ("a", 3, 2), ("b", 7, 0)]
    assert visibility.kept_history(df, ["d"], "chunk", 1, 0).count() == df.count()


def test_history_by_the_time_of_each_view(spark):
    df = spark.createDataFrame([("a", c, s) for c in range(5) for s in (-1, 0, 1)], "d string, chunk long, scope long")
    times = {0: [(0, 5), (5, 10), (10, 30), (30, 32), (32, 40)], 1: [(0, 50), (50, 60)]}
    i = spark.createDataFrame([("a", s, c, float(x), float(y)) for s, own in times.items() for c, (x, y) in enumerate(own)], "d string, scope long, chunk long, start double, end double")
    want = set()
    for c in range(5):
        for s in (-1, 0, 1):
            for view, own in times.items():
                x, y = own[min(c, len(own) - 1)]
                if s in (-1, view) and (x < 5 or y > own[min(4, len(own) - 1)][1] - 9):
                    want.add(("a", c, s))
    assert set(values(visibility.kept_history_by_time(df, ["d"], "chunk", "scope", i, 5, 9), "d", "chunk", "scope")) == want and len(want) < 15


def test_tiles_widen_the_first_overlaps(spark):
    def starts(length, tile, overlap, unit):
        if tile >= length:
            return [0]
        n = 2
        while tile * n - overlap * (n - 1) < length:
            n += 1
        spare, gaps = tile * n - overlap * (n - 1) - length, [overlap] * (n - 1)
        for k in range(spare // unit):
            gaps[k % (n - 1)] += unit
        return [tile * k - sum(gaps[:k]) for k in range(n)]

    df = spark.range(1, 400).withColumnRenamed("id", "n")
    for unit in (1, 8):
        got = dict(values(df.select("n", packing.tile_starts("n", 64, 16, unit).alias("t")), "n", "t"))
        assert got == {n: starts(n, 64, 16, unit) for n in range(1, 400)}
    assert starts(180, 64, 16, 1) == [0, 38, 77, 116]


def test_row_padding_repeats_or_is_null(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")], "g string, i long, v string")
    assert sorted(values(packing.padded_rows(df, ["g"], "i", 2).where("pad"), "g", "i", "v")) == [("b", 1, "z")]
    assert sorted(values(packing.padded_rows(df, ["g"], "i", 2, repeat_last=False).where("pad"), "g", "i", "v")) == [("b", 1, None)]


def test_group_sizes(spark):
    df = spark.createDataFrame([(seed, count) for seed in range(16) for count in (0, 1, 2, 3, 5, 8, 13, 21, 34, 55)], "k long, n long")
    drawn = set()
    for r in partitioning.plan_groups(df, ["k", "n"], "n", 2, 4).collect():
        assert sum(r.sizes) == r.n and all(2 <= x <= 4 for x in r.sizes[:-1]) and all(1 <= x <= 4 for x in r.sizes[-1:])
        drawn.add(tuple(r.sizes))
    assert len(drawn) > 60


def plans(total, tails, least, most, at=0):
    """All sound plans, by trying every size: each block holds enough of every view that it meets, and no view's support is cut off."""
    if at == total:
        return [[]]
    out = []
    for b in range(at + min(least, total), min(at + most, total) + 1):
        if all(a_end <= at or (min(b, a_end) - at >= min(least, a_end) and not requested <= b < a_end) for a_end, requested in tails):
            out += [[b - at, *rest] for rest in plans(total, tails, least, most, b)]
    return out


def test_planned_blocks_are_the_sound_ones(spark):
    r = random.Random(4)
    rows = []
    for k in range(60):
        tails = [(n, n - r.randint(0, 3)) for n in (r.randint(1, 14) for _ in range(r.randint(1, 3)))]
        if plans(max(n for n, _ in tails), tails, 2, 5):
            rows.append((k, tails))
    assert len(rows) > 30
    df = spark.createDataFrame([(k, s, tails) for k, tails in rows for s in range(12)], "k long, s long, tails array<struct<latents: int, requested: int>>")
    found = {}
    for x in partitioning.plan_blocks(df, ["k", "s"], "tails", 2, 5).collect():
        found.setdefault(x.k, set()).add(tuple(x.sizes))
    for k, tails in rows:
        sound = set(map(tuple, plans(max(n for n, _ in tails), tails, 2, 5)))
        assert found[k] <= sound and (len(sound) == 1 or len(found[k]) > 1)


def test_infeasible_plan_is_refused(spark):
    df = spark.createDataFrame([(1, [(10, 5)])], "k long, tails array<struct<latents: int, requested: int>>")
    with pytest.raises(Exception, match="no blocks cover a document of latents 10"):
        partitioning.plan_blocks(df, ["k"], "tails", 3, 3).collect()


def test_walks_of_frames(spark):
    df = spark.createDataFrame([(k, 60) for k in range(8)], "k long, n long")
    back = partitioning.momentum_walk(df, ["k"], "n", 5, "n", frame_speed=(-2.0, -1.0)).collect()
    both = partitioning.momentum_walk(df, ["k"], "n", 5, "n", frame_speed=(-2.0, 2.0), frame_push=(-6.0, 6.0)).collect()
    walks = lambda rows: {k: [x.frame for x in sorted(rows, key=lambda x: x.step) if x.k == k] for k in range(8)}
    for frames in walks(back).values():
        assert frames[0] == 59 and all((a - b) % 60 in (1, 2) for a, b in zip(frames, frames[1:]))
    assert len({f[0] for f in walks(both).values()}) > 1
    assert {(b - a + 30) % 60 - 30 for f in walks(both).values() for a, b in zip(f, f[1:])} >= {-2, 0, 2}


def test_walk_moves_smoothly(spark):
    df = spark.createDataFrame([(1, 60), (2, 1)], "k long, n long")
    rows = partitioning.momentum_walk(df, ["k"], "n", 12, "n").where("k = 1").orderBy("step").collect()
    assert [r.step for r in rows] == list(range(60)) and all(0 <= r.view < 12 for r in rows)
    steps = [min((b.view - a.view) % 12, (a.view - b.view) % 12) for a, b in zip(rows, rows[1:])]
    assert max(steps) <= 3


def test_required_fails_on_a_miss(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    assert joins.required(a.where("k = 1"), b, ["k"]).count() == 1
    with pytest.raises(Exception, match="no match for 2"):
        joins.required(a, b, ["k"]).collect()


def test_state_changes(spark):
    now = spark.createDataFrame([(1, 5, "a"), (2, 6, "b"), (3, 7, "c")], "k long, v long, w string")
    old = spark.createDataFrame([(1, 5, "a"), (2, 0, "b"), (3, 7, "z"), (4, 1, "q")], "k long, v long, w string")
    assert dict(values(joins.changed_since(now, old, "k", [], ["w"]), "k", "status")) == {1: "same", 2: "stale", 3: "allowed", 4: "gone"}


def test_first_source_wins(spark):
    a, b = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k long, v string")
    assert sorted(values(sets.first_wins({"a": a, "b": b}, ["k"]), "k", "v")) == [(1, "a"), (2, "b")]


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("g", 1), ("g", 2)], "g string, v long")
    assert values(stats.fingerprint(a, ["g"], ["v"]), "fingerprint") == values(stats.fingerprint(a.orderBy(F.col("v").desc()), ["g"], ["v"]), "fingerprint")


def test_asof_ties_and_strictness(spark):
    left = spark.createDataFrame([("a", 5), ("a", 4)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1), ("a", 3, 0)], "k string, rt long, v long")
    assert sorted(values(joins.asof_join(left, right, ["k"], "t", "rt", ["v"]), "t", "v")) == [(4, 0), (5, 1)]
    assert sorted(values(joins.asof_join(left, right, ["k"], "t", "rt", ["v"], strict=True), "t", "v")) == [(4, 0), (5, 0)]


def test_weights_of_an_empty_mixture(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "s string, eff long")
    assert {r.weight for r in sampling.mixture_weights(df).collect()} == {0.0}
