"""Queries on time axes, joins, packing, visibility, statistics and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import filters as P
from ..operators import joins as J
from ..operators import packing as K
from ..operators import partitioning as D
from ..operators import stats as A
from ..operators import timebase as T
from ..operators import visibility as V
from .registry import query, table, unit_sql


@query(
    """WITH p AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS frames FROM part),
       n AS (SELECT *, CASE WHEN frames = 1 THEN 1 ELSE 5 * greatest(0, CAST(ceil((frames - 5) / 17.0) AS BIGINT)) + 2 END AS latents FROM p),
       l AS (SELECT *, unnest(range(0, latents)) AS latent FROM n)
       SELECT p_partkey, latent, least(17 * (latent // 5) + 4 * (latent % 5), frames - 1) AS camera_frame,
              17 * (latent // 5) + [0, 1, 5, 9, 13][latent % 5 + 1] AS start, 17 * (latent // 5) + [0, 1, 5, 9, 13][latent % 5 + 1] < frames AS valid,
              round((17 * (latent // 5) + [0, 1, 5, 9, 13][latent % 5 + 1]) * (40.0 / 24), 9) AS clock FROM l"""
)
def temporal_layout(spark, sf_dir):
    """Latents of clips, their camera frames, starts, validity and clock."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("frames"))
    out = T.temporal_layout(p, "frames")
    return out.select("p_partkey", "latent", "camera_frame", "start", "valid", F.round(T.rotary_clock("latent", F.lit(24.0)), 9).alias("clock"))


_LATENTS = "SELECT o_orderkey, o_custkey % 150 + 1 AS frames, unnest(range(0, CASE WHEN o_custkey % 150 = 0 THEN 1 ELSE 5 * greatest(0, CAST(ceil((o_custkey % 150 - 4) / 17.0) AS BIGINT)) + 2 END)) AS latent FROM orders"


@query(
    f"""WITH s AS (SELECT *, 17 * (latent // 5) + [0, 1, 5, 9, 13][latent % 5 + 1] AS start FROM ({_LATENTS})),
        b AS (SELECT *, CAST(floor((start + 3) / 20.0) AS BIGINT) AS raw FROM s),
        c AS (SELECT *, least(raw, max(CASE WHEN start < frames THEN raw END) OVER (PARTITION BY o_orderkey)) AS block FROM b),
        r AS (SELECT *, lag(block) OVER (PARTITION BY o_orderkey ORDER BY latent) IS DISTINCT FROM block AS f FROM c)
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY latent) - 1 AS run, block, start, coalesce(lead(start) OVER (PARTITION BY o_orderkey ORDER BY latent), frames) AS stop FROM r WHERE f"""
)
def block_intervals(spark, sf_dir):
    """Blocks of clips as intervals, from their latents."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150 + 1).alias("frames"))
    return T.block_intervals(o, ["o_orderkey"], "frames", F.lit(5))


@query("SELECT p_partkey, i, least(CAST(round_even(i * 1.5, 0) AS BIGINT), p_size - 1) AS frame FROM (SELECT p_partkey, p_size, unnest(range(0, p_size)) AS i FROM part)")
def frame_stride(spark, sf_dir):
    """Frames one and a half apart, rounded half to even."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    return T.strided_frames(p, "n", F.lit(1.5), "n").select("p_partkey", "i", "frame")


@query("SELECT p_partkey, i, CASE WHEN k = 1 THEN 0 ELSE (i * (n - 1)) // (k - 1) END AS place FROM (SELECT p_partkey, n, k, unnest(range(0, k)) AS i FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, least(7, CAST(p_size AS BIGINT)) AS k FROM part))")
def even_picks(spark, sf_dir):
    """Seven evenly spaced places of each clip."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    return T.even_picks(p, "n", 7).select("p_partkey", "i", "place")



@query(
    """WITH r(src, m, s) AS (VALUES (15.0, 16.0, 16.0), (23.976, 16.0, 24.0), (25.0, 16.0, 24.0), (29.97, 15.0, 30.0), (29.997, 15.0, 30.0), (29.916666666666668, 15.0, 30.0), (30.0, 15.0, 30.0),
                                  (47.952047952047955, 16.0, 48.0), (50.0, 15.0, 50.0), (59.94, 15.0, 60.0), (60.0, 15.0, 60.0), (60.08010680907877, 15.0, 60.0)),
       o AS (SELECT o_orderkey, CAST(12 + o_orderkey % 50 AS DOUBLE) AS fps FROM orders),
       f AS (SELECT DISTINCT fps FROM o),
       near AS (SELECT fps, min_by(struct_pack(src := src, m := m, s := s), abs(fps / src - 1.0)) AS n, min(abs(fps / src - 1.0)) AS d FROM f, r GROUP BY fps),
       t AS (SELECT fps, CASE WHEN d = 0 THEN n.m WHEN CAST(fps AS BIGINT) % 8 = 0 THEN 16.0 WHEN d <= 0.10 THEN n.m ELSE 16.0 END AS model_fps,
                    CASE WHEN d = 0 THEN n.s WHEN CAST(fps AS BIGINT) % 8 = 0 THEN fps WHEN d <= 0.10 THEN n.s ELSE fps END AS snapped_fps FROM near)
       SELECT o_orderkey, fps, CAST(model_fps AS DOUBLE) AS model_fps, CAST(snapped_fps AS DOUBLE) AS snapped_fps FROM o JOIN t USING (fps)"""
)
def fps_snap(spark, sf_dir):
    """Rates snapped to registered ones, by ratio, through a table of the distinct rates."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (12 + F.col("o_orderkey") % 50).cast("double").alias("fps"))
    rates = T.rate_table(spark, 16, [float(x) for x in range(12, 62)])
    return o.join(J.small(rates), o.fps == rates.src_fps).select("o_orderkey", "fps", "model_fps", "snapped_fps")


@query("SELECT o_orderkey, f.k AS nearest FROM (SELECT o_orderkey, list_sort([struct_pack(d := abs(v - 1.0), i := 0, k := 1.0::DOUBLE), struct_pack(d := abs(v - 2.0), i := 1, k := 2.0::DOUBLE), struct_pack(d := abs(v - 5.0), i := 2, k := 5.0::DOUBLE)])[1] AS f FROM (SELECT o_orderkey, CAST(o_custkey % 7 AS DOUBLE) AS v FROM orders))")
def nearest_factor(spark, sf_dir):
    """The nearest of a list of factors; the first wins ties."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).cast("double").alias("v"))
    return T.nearest(o, "v", [1.0, 2.0, 5.0]).select("o_orderkey", "nearest")


@query(
    """WITH c AS (SELECT event_id, event_id % 400 AS f, 400 AS nv, CASE event_id % 4 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 399 ELSE 200 END AS nc FROM events)
       SELECT event_id, CASE WHEN nc = nv THEN f WHEN abs(nc - nv) <= 1 THEN least(f, nc - 1) ELSE least(CAST(round_even(f * ((nc - 1) / greatest(1, nv - 1)), 0) AS BIGINT), nc - 1) END AS pose FROM c"""
)
def nearest_pose(spark, sf_dir):
    """Pose index of video frames, for equal, off-by-one and subsampled tracks."""
    k = F.col("event_id")
    nc = F.when(k % 4 == 0, 400).when(k % 4 == 1, 401).when(k % 4 == 2, 399).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", T.pose_index(k % 400, F.lit(400), nc).alias("pose"))


_OVERLAP = """WITH conv AS (SELECT conv_id, max(turn) + 1 AS turns FROM conversations GROUP BY conv_id),
       blocks AS (SELECT conv_id, b, 17 * b AS start, 17 * (b + 1) AS stop FROM (SELECT conv_id, unnest(range(0, turns)) AS b FROM conv)),
       w AS (SELECT conv_id, turn, text, greatest(0, 20 * turn - 3) AS l, 20 * (turn + 1) - 3 AS r FROM conversations),
       hit AS (SELECT blocks.conv_id, b, turn, text FROM blocks LEFT JOIN w ON blocks.conv_id = w.conv_id AND 2 * greatest(0, least(stop, r) - greatest(start, l)) > (r - l))"""


@query(_OVERLAP + " SELECT conv_id, b AS block, turn FROM hit")
def caption_overlap(spark, sf_dir):
    """Captions matched to the blocks that cover most of their window."""
    return _overlap(spark, sf_dir).select("conv_id", "block", "turn")


def _overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("turns"))
    b = turns.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("block"))
    b = b.select("conv_id", "block", (17 * F.col("block")).alias("start"), (17 * (F.col("block") + 1)).alias("stop"))
    w = c.select("conv_id", "turn", "text", F.greatest(F.lit(0), 20 * F.col("turn") - 3).alias("left"), (20 * (F.col("turn") + 1) - 3).alias("right"))
    return J.overlap_join(b, w, ["conv_id"])


@query(_OVERLAP + " SELECT conv_id, b AS block, count(turn) AS n, md5(coalesce(string_agg(text, chr(10) ORDER BY turn), '')) AS caption FROM hit GROUP BY conv_id, b")
def caption_concat(spark, sf_dir):
    """The captions of each block, in order, as one text."""
    hit = _overlap(spark, sf_dir).groupBy("conv_id", "block").agg(F.count("turn").alias("n"), F.array_sort(F.collect_list(F.when(F.col("turn").isNotNull(), F.struct("turn", "text")))).alias("t"))
    return hit.select("conv_id", "block", "n", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("caption"))


@query(
    """WITH k AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
       SELECT e.event_id, k.event_id AS keyframe FROM events e ASOF LEFT JOIN k ON e.user_id = k.user_id AND e.ts >= k.ts"""
)
def keyframe_asof(spark, sf_dir):
    """The last purchase at or before each event of a user."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    k = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("key_ts"), F.col("event_id").alias("keyframe"))
    return J.asof_join(e, k, ["user_id"], "ts", "key_ts", ["keyframe"]).select("event_id", "keyframe")


@query(
    """WITH r AS (SELECT conv_id, turn, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations),
       p AS (SELECT DISTINCT conv_id, unnest([0, 100, 1000, 2500]) AS pos FROM conversations)
       SELECT p.conv_id, CAST(pos AS BIGINT) AS pos, turn FROM p JOIN r ON p.conv_id = r.conv_id AND pos >= s AND pos < s + n"""
)
def run_length_bucket(spark, sf_dir):
    """The run that holds a position, for runs laid end to end."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    p = c.select("conv_id").distinct().withColumn("pos", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 100, 1000, 2500)])))
    return J.bucket_of(p, ["conv_id"], "pos", c, "turn", "n", ["turn"]).select("conv_id", "pos", "turn")


@query("SELECT a.label, round(max(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS span FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <= b.vec_id GROUP BY a.label")
def pairwise_span(spark, sf_dir):
    """Largest distance inside each group of vectors."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    return J.largest_distance(e, ["label"], "vec_id", "embedding").select("label", F.round("span", 6).alias("span"))


@query(
    """WITH s AS (SELECT a.label, max(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS span FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <= b.vec_id GROUP BY a.label)
       SELECT label, list_sort([struct_pack(d := abs(log10(span) - log10(0.1)), f := 0.1::DOUBLE), struct_pack(d := abs(log10(span) - 0.0), f := 1.0::DOUBLE), struct_pack(d := abs(log10(span) - 1.0), f := 10.0::DOUBLE), struct_pack(d := abs(log10(span) - 2.0), f := 100.0::DOUBLE)])[1].f AS factor FROM s"""
)
def stable_factor(spark, sf_dir):
    """The power of ten nearest to each group's span, by logarithm."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    s = J.largest_distance(e, ["label"], "vec_id", "embedding").withColumn("lg", F.log10("span"))
    return T.nearest(s, "lg", [-1.0, 0.0, 1.0, 2.0]).select("label", F.round(F.pow(F.lit(10.0), "nearest"), 6).alias("factor"))


@query("SELECT p_partkey, k, least(greatest(p_size - 3 + k, 0), 40) AS frame FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, unnest(range(0, 4)) AS k FROM part)")
def support_frames(spark, sf_dir):
    """The four camera frames that support a latent."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("a"))
    return J.support_frames(p, "a", F.lit(40)).select("p_partkey", "k", "frame")


@query("SELECT conv_id, count(DISTINCT sha256(role)) = 1 AND count(role) = count(DISTINCT turn) AS shared FROM conversations GROUP BY conv_id")
def shared_text(spark, sf_dir):
    """Documents whose views all have one text."""
    return J.shared_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role")


@query("SELECT conv_id, CAST(length(role) AS BIGINT) AS caption, min_by(turn // 2, turn) AS block FROM conversations GROUP BY conv_id, length(role)")
def first_match(spark, sf_dir):
    """The block of the first position of each caption."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.length("role").cast("long").alias("caption"), "turn", F.floor(F.col("turn") / 2).cast("long").alias("block"))
    return J.enclosing_block(c, ["conv_id"], "caption", "turn", "block")


@query("SELECT l_orderkey, l_partkey, i AS camera, p_name FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_partkey END AS i FROM lineitem) LEFT JOIN part ON i = p_partkey AND i >= 0")
def index_join(spark, sf_dir):
    """Rows by number, where -1 is none."""
    li = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("g"), "l_orderkey", "l_partkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_partkey")).alias("camera"))
    p = table(spark, sf_dir, "part").select(F.lit(0).alias("g"), F.col("p_partkey").alias("camera"), "p_name")
    return J.indexed(li, p, ["g"], "camera", ["p_name"]).select("l_orderkey", "l_partkey", "camera", "p_name")


@query(
    """SELECT conv_id, turn AS view, role, CAST(length(text) AS BIGINT) AS size FROM conversations"""
)
def explode_views(spark, sf_dir):
    """Per-view lists gathered and flattened again, sample-major."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("size"))
    wide = K.gathered_views(c, ["conv_id"], "turn", ["role", "size"])
    return K.exploded_views(wide, ["conv_id"], ["role", "size"], "views")


@query(
    """SELECT doc_id, source, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, n_chars + (6144 - n_chars % 6144) % 6144 AS padded FROM documents"""
)
def token_offsets(spark, sf_dir):
    """Running token offsets, and lengths padded to a multiple of degree and bucket."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return K.running_offsets(d, ["source"], ["doc_id"], "n_chars").withColumn("padded", K.padded_length("n_chars", F.lit(6), F.lit(2048)))


@query(
    """WITH t AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
       SELECT conv_id, turn, CAST(n AS BIGINT) AS n, false AS pad FROM t UNION ALL
       SELECT conv_id, turn + k, CAST(n AS BIGINT), true FROM (SELECT conv_id, turn, n, unnest(range(1, (4 - c % 4) % 4 + 1)) AS k FROM t WHERE r = c)"""
)
def row_padding(spark, sf_dir):
    """Groups padded with copies of their last row to a multiple of four."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return K.padded_rows(c, ["conv_id"], "turn", 4)


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) - 1 AS place, CAST(coalesce(sum(CASE WHEN turn <= 1 THEN length(text) END) OVER (PARTITION BY conv_id), 0) AS BIGINT) AS origin FROM conversations")
def segment_order(spark, sf_dir):
    """Segments in contract order, and where each group's time begins."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"), (F.col("turn") - 1).alias("chunk"))
    out = K.segment_order(c, ["conv_id"], "role", ["turn"], ["system", "user"])
    return K.text_origin(out, ["conv_id"], "n", "chunk").select("conv_id", "turn", "place", "origin")


@query("WITH k AS (SELECT l_discount, l_tax, row_number() OVER (ORDER BY l_discount, l_tax) - 1 AS level FROM (SELECT DISTINCT l_discount, l_tax FROM lineitem)) SELECT l_discount, l_tax, level, count(*) AS n FROM lineitem JOIN k USING (l_discount, l_tax) GROUP BY ALL")
def distinct_levels(spark, sf_dir):
    """Numbers of the distinct combinations of two columns."""
    li = table(spark, sf_dir, "lineitem").select("l_discount", "l_tax")
    return K.dense_levels(li, ["l_discount", "l_tax"]).groupBy("l_discount", "l_tax", "level").agg(F.count("*").alias("n"))


@query(
    """WITH p AS (SELECT p_partkey, CAST(p_size * 20 AS BIGINT) AS len FROM part),
       n AS (SELECT *, CASE WHEN len <= 64 THEN 1 ELSE CAST(ceil((len - 16) / 48.0) AS BIGINT) END AS k FROM p),
       u AS (SELECT *, greatest(64 * k - 16 * (k - 1) - len, 0) // 4 AS units FROM n),
       o AS (SELECT *, list_transform(range(k - 1), lambda x: 16 + 4 * (units // greatest(k - 1, 1) + CASE WHEN x < units % greatest(k - 1, 1) THEN 1 ELSE 0 END)) AS laps FROM u)
       SELECT p_partkey, i, CAST(64 * i - coalesce(list_sum(laps[1:i]), 0) AS BIGINT) AS start FROM (SELECT *, unnest(range(0, k)) AS i FROM o)"""
)
def tile_layout(spark, sf_dir):
    """Overlapping tiles that cover a length, their overlaps widened in turn by aligned units."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(K.tile_starts(F.col("p_size").cast("long") * 20, 64, 16, 4)).alias("i", "start"))
    return p.select("p_partkey", F.col("i").cast("long").alias("i"), "start")


@query("WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, t, unnest(range(0, len(t))) AS start FROM c), e AS (SELECT conv_id, t, start, unnest(range(start + 1, len(t) + 1)) AS stop FROM s) SELECT conv_id, start, stop, CAST(list_sum(t[start + 1 : stop]) AS BIGINT) AS total FROM e")
def sub_ranges(spark, sf_dir):
    """Every contiguous part of each conversation."""
    c = K.gathered_views(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("t")), ["conv_id"], "turn", ["t"])
    out = K.sub_ranges(c, ["conv_id"], "t")
    return out.select("conv_id", "start", "stop", F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# ---- visibility: conversations as token sequences

_TOKENS = "SELECT conv_id, turn AS pos, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS kind, CASE WHEN role = 'system' THEN -1 ELSE turn // 2 END AS chunk, CASE WHEN turn % 3 = 0 THEN -1 ELSE turn % 3 END AS scope, turn % 7 <> 5 AS active FROM conversations"
_SEES = """((k.kind = 0 AND k.chunk <= q.chunk) OR (q.kind = 1 AND k.kind = 1 AND k.chunk <= q.chunk) OR (q.kind = 2 AND k.kind = 1 AND k.chunk < q.chunk) OR (q.kind = 2 AND k.kind = 2 AND k.chunk = q.chunk))
            AND (k.scope < 0 OR q.scope = k.scope)"""


def _tokens(spark, sf_dir):
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        t.alias("pos"),
        F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("kind"),
        F.when(F.col("role") == "system", F.lit(-1)).otherwise(F.floor(t / 2)).cast("long").alias("chunk"),
        F.when(t % 3 == 0, F.lit(-1)).otherwise(t % 3).alias("scope"),
        (t % 7 != 5).alias("active"),
    )


@query(f"WITH t AS ({_TOKENS}) SELECT q.conv_id, count(DISTINCT CASE WHEN q.active THEN q.pos END) AS tokens, count(CASE WHEN (q.active AND k.active AND {_SEES}) OR (NOT q.active AND q.pos = k.pos) THEN 1 END) AS pairs FROM t q JOIN t k ON q.conv_id = k.conv_id GROUP BY q.conv_id")
def visibility_counts(spark, sf_dir):
    """Visible token pairs per document, by classes."""
    return V.visible_counts(_tokens(spark, sf_dir), ["conv_id"])


@query(
    f"""WITH t AS (SELECT * FROM ({_TOKENS}) WHERE active),
        s AS (SELECT q.conv_id, q.kind, q.chunk, q.scope, q.pos, list(k.pos ORDER BY k.pos) AS sees FROM t q JOIN t k ON q.conv_id = k.conv_id AND {_SEES} GROUP BY ALL),
        g AS (SELECT conv_id, sees, min(struct_pack(kind := kind, chunk := chunk, scope := scope)) AS f, count(*) AS queries FROM s GROUP BY conv_id, sees)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY f) - 1 AS "group", queries, CAST(len(sees) AS BIGINT) AS keys FROM g"""
)
def visibility_groups(spark, sf_dir):
    """Queries grouped by the set of keys that they see."""
    return V.visibility_groups(_tokens(spark, sf_dir), ["conv_id"])


@query(
    f"""WITH t AS (SELECT * FROM ({_TOKENS}) WHERE active), c AS (SELECT q.conv_id, q.pos // 2 AS q_tile, k.pos // 2 AS k_tile, count(*) AS visible FROM t q JOIN t k ON q.conv_id = k.conv_id AND {_SEES} GROUP BY ALL)
        SELECT *, CASE WHEN visible = 4 THEN 'full' ELSE 'partial' END AS status, row_number() OVER (PARTITION BY conv_id, q_tile ORDER BY visible DESC, k_tile) - 1 AS place FROM c"""
)
def tile_counts(spark, sf_dir):
    """Visible pairs by tiles of two, their status and order."""
    return V.ordered_tiles(V.tile_counts(_tokens(spark, sf_dir), ["conv_id"], "pos", 2), ["conv_id"])


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, turn // 2 AS chunk, max(turn // 2) OVER (PARTITION BY conv_id) AS newest FROM conversations) WHERE (chunk < 1 AND turn % 2 = 0) OR chunk > newest - 2")
def history_window(spark, sf_dir):
    """The first chunk (of view 0) and the last two of each conversation, two views a chunk."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("long").alias("chunk"), (F.col("turn") % 2).alias("scope"))
    return V.kept_history(t, ["conv_id"], "chunk", 1, 2, "scope", sink_scope_zero=True).select("conv_id", "turn")


@query(
    """WITH t AS (SELECT conv_id, turn, turn // 2 AS chunk, CASE WHEN turn % 3 = 0 THEN -1 ELSE turn % 3 - 1 END AS scope FROM conversations),
       m AS (SELECT conv_id, max(chunk) AS newest FROM t GROUP BY conv_id),
       s AS (SELECT conv_id, newest, sc, CASE sc WHEN 0 THEN newest ELSE greatest(newest - 1, 0) END AS top FROM m, (VALUES (0), (1)) v(sc))
       SELECT conv_id, turn FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.conv_id = t.conv_id AND (t.scope < 0 OR t.scope = s.sc)
           AND (10 * least(t.chunk, top) + 3 * sc < 8 OR 10 * least(t.chunk, top) + 10 + 3 * sc > 10 * least(newest, top) + 10 + 3 * sc - 15))"""
)
def history_by_time(spark, sf_dir):
    """Rows whose chunk starts early or ends late, by each view's own time; shared rows by any view's."""
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.floor(F.col("turn") / 2).cast("long").alias("chunk"), F.when(F.col("turn") % 3 == 0, F.lit(-1)).otherwise(F.col("turn") % 3 - 1).cast("long").alias("scope")
    )
    # view 1 has a chunk less, and starts a little later
    views = t.groupBy("conv_id").agg(F.max("chunk").alias("top")).withColumn("scope", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    i = views.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("top") - F.col("scope"), F.lit(0).cast("long")))))
    i = i.select("conv_id", "scope", "chunk", (10 * F.col("chunk") + 3 * F.col("scope")).alias("start"), (10 * F.col("chunk") + 10 + 3 * F.col("scope")).alias("end"))
    return V.kept_history_by_time(t, ["conv_id"], "chunk", "scope", i, 8, 15).select("conv_id", "turn")


@query(
    """WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) % 50 + 1 AS n, [2, 8, 4][turn % 3 + 1] AS b, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations),
       f AS (SELECT conv_id, turn, r, n, least(n, 200 // b) AS kept, least(n, 200 // b) * b AS used FROM s WHERE r = 1
             UNION ALL SELECT s.conv_id, s.turn, s.r, s.n, least(s.n, (200 - used) // s.b), used + least(s.n, (200 - used) // s.b) * s.b FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
       SELECT conv_id, turn, CAST(kept AS BIGINT) AS kept, CAST(n - kept AS BIGINT) AS moved FROM f"""
)
def byte_budget(spark, sf_dir):
    """Newest first, what fits in a budget of bytes, with tokens of different sizes."""
    size = F.element_at(F.array(F.lit(2), F.lit(8), F.lit(4)), (F.col("turn") % 3 + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 50 + 1).alias("n"), size.alias("b"))
    return V.byte_budget(c, ["conv_id"], "turn", "n", "b", 200).select("conv_id", "turn", "kept", "moved")


# ---- statistics


@query(
    """SELECT l_returnflag, round(CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(28, 9))) AS DOUBLE) / greatest(CAST(sum(CAST(l_discount AS DECIMAL(28, 9))) AS DOUBLE), 1.0), 6) AS loss,
              round(CAST(sum(CAST(l_quantity AS DECIMAL(28, 9))) FILTER (l_linestatus = 'O') AS DOUBLE) / count(*) FILTER (l_linestatus = 'O'), 6) AS mean, min(l_quantity) FILTER (l_linestatus = 'O') AS least, max(l_quantity) FILTER (l_linestatus = 'O') AS most FROM lineitem GROUP BY l_returnflag"""
)
def weighted_loss(spark, sf_dir):
    """Weighted means and statistics of supervised rows."""
    mean, least, most = A.supervised("l_quantity", F.col("l_linestatus") == "O")
    out = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.weighted_mean("l_extendedprice", "l_discount").alias("loss"), mean.alias("mean"), least.alias("least"), most.alias("most"))
    return out.withColumns({"loss": F.round("loss", 6), "mean": F.round("mean", 6)})


@query("SELECT l_orderkey, count(*) AS blocks, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def block_histogram(spark, sf_dir):
    """Sizes of the blocks of each group."""
    return A.block_histogram(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber")


@query(
    """WITH s AS (SELECT user_id, quantile_cont(value / 500, 0.5) AS m, quantile_cont(value / 500, 0.95) AS p FROM events GROUP BY user_id)
       SELECT user_id, round(m, 6) AS median, round(p, 6) AS p95, round(CASE WHEN m < 0.10 AND p < 0.30 THEN ln(0.16) / ln(greatest(m, 1e-3)) WHEN m > 0.80 THEN ln(0.66) / ln(least(m, 1 - 1e-3)) ELSE 1.0 END, 6) AS gamma FROM s"""
)
def exposure_gamma(spark, sf_dir):
    """Exposure statistics and the exponent that corrects them."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 500).alias("x"))
    return A.exposure_gamma(e, ["user_id"], "x").select("user_id", *[F.round(c, 6).alias(c) for c in ("median", "p95", "gamma")])


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS day, max(value) AS max_value, round(CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) / count(value), 6) AS avg_value, CASE WHEN count(v) = count(*) THEN round(CAST(sum(CAST(v AS DECIMAL(28, 9))) AS DOUBLE) / count(v), 6) END AS all_v, bool_or(b) AS any_b, bool_and(b) AS every_b
       FROM (SELECT *, CASE WHEN user_id % 50 <> 3 THEN value END AS v, value > 1 AS b FROM events) GROUP BY 1"""
)
def replica_reduce(spark, sf_dir):
    """Metrics of replicas reduced by step: worst, mean, mean if complete, any, all."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value", F.when(F.col("user_id") % 50 != 3, F.col("value")).alias("v"), (F.col("value") > 1).alias("b"))
    out = A.replica_reduce(e, ["day"], worst=["value"], mean=["value"], covered=["v"], any_of=["b"], all_of=["b"])
    return out.withColumns({"avg_value": F.round("avg_value", 6), "all_v": F.round("all_v", 6)})


@query("SELECT user_id, first, last, round((first - last) / nullif(first, 0), 9) AS gain, coalesce((first - last) / nullif(first, 0) >= 0.5, false) AS passed FROM (SELECT user_id, min_by(value, ts) AS first, max_by(value, ts) AS last FROM events GROUP BY user_id)")
def improvement(spark, sf_dir):
    """Relative improvement from the first to the last evaluation."""
    return A.improvement(table(spark, sf_dir, "events"), ["user_id"], "ts", "value", 0.5).withColumn("gain", F.round("gain", 9))


@query("SELECT event_type, CAST(user_id % 5 AS BIGINT) AS sigma, round(CAST(sum(CAST(value AS DECIMAL(28, 9))) AS DOUBLE) / count(value), 6) AS mean, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def evaluation_grid(spark, sf_dir):
    """Means of a grid with totals."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 5).alias("sigma"), "value")
    return A.evaluation_grid(e, "event_type", "sigma", "value").withColumn("mean", F.round("mean", 6))


@query("SELECT user_id, round(CAST(sum(CAST(d * d AS DECIMAL(28, 12))) AS DOUBLE) / count(d), 9) AS mse, round(CAST(sum(CAST(abs(d) AS DECIMAL(28, 12))) AS DOUBLE) / count(d), 9) AS mae, round(-10 * log10(CAST(sum(CAST(d * d AS DECIMAL(28, 12))) AS DOUBLE) / count(d)), 6) AS psnr FROM (SELECT user_id, value / 1000 - (event_id % 10) / 10.0 AS d FROM events) GROUP BY user_id")
def signal_metrics(spark, sf_dir):
    """Error metrics of two signals."""
    e = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 1000).alias("a"), ((F.col("event_id") % 10) / 10.0).alias("b"))
    return A.signal_metrics(e, ["user_id"], "a", "b").select("user_id", F.round("mse", 9).alias("mse"), F.round("mae", 9).alias("mae"), F.round("psnr", 6).alias("psnr"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def consecutive_dedup(spark, sf_dir):
    """Events whose type differs from the one before."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return A.consecutive_distinct(e, ["user_id"], ["ts"], "event_type").drop("ts")


@query(
    """WITH RECURSIVE o AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders),
       e AS (SELECT o_custkey, r, v AS a FROM o WHERE r = 1 UNION ALL SELECT o.o_custkey, o.r, 0.9 * e.a + 0.1 * o.v FROM e JOIN o ON o.o_custkey = e.o_custkey AND o.r = e.r + 1)
       SELECT o_custkey, round(max_by(a, r), 2) AS ema, max(r) AS n FROM e GROUP BY o_custkey"""
)
def ema_fold(spark, sf_dir):
    """Exponential moving average of each customer's orders."""
    o = table(spark, sf_dir, "orders")
    return A.moving_average(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 0.9).select("o_custkey", F.round("ema", 2).alias("ema"), "n")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey * 37 % 100 AS v FROM orders),
       j AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) > 50, false) AS j FROM o)
       SELECT o_custkey, o_orderkey, CASE WHEN sum(CAST(j AS INT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) % 2 = 1 THEN 100 - v ELSE v END AS unfolded FROM j"""
)
def wrap_unfold(spark, sf_dir):
    """A ring position made continuous."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", (F.col("o_orderkey") * 37 % 100).alias("v"))
    return A.unfolded(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "v", 100).select("o_custkey", "o_orderkey", "unfolded")


@query("SELECT l_orderkey, round(l_extendedprice / max(abs(l_extendedprice)) OVER (PARTITION BY l_orderkey), 9) AS scaled, least(1.0::DOUBLE, (l_linenumber + 1) / 5.0::DOUBLE) AS rate FROM lineitem")
def scale_to_one(spark, sf_dir):
    """Values scaled to their group's greatest, and a warm-up ramp."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_linenumber")
    return A.scaled_to_one(li, ["l_orderkey"], "l_extendedprice").select("l_orderkey", F.round("scaled", 9).alias("scaled"), A.warm_up("l_linenumber", 5).alias("rate"))


@query("SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts) AS peak FROM events")
def running_peak(spark, sf_dir):
    """Running maximum."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return A.running_peak(e, ["user_id"], ["ts"], "value").select("user_id", "event_id", "peak")


@query("SELECT source, count(*) AS requests, count(DISTINCT md5(text)) AS keys, count(*) FILTER (doc_id % 4 <> 0) AS misses, count(DISTINCT CASE WHEN doc_id % 4 <> 0 THEN md5(text) END) AS made FROM documents GROUP BY source")
def cache_report(spark, sf_dir):
    """Requests, keys and misses of a cache."""
    d = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("key"), (F.col("doc_id") % 4 == 0).alias("hit"))
    return A.cache_statistics(d, ["source"], "key", "hit")


@query(
    """WITH r AS (SELECT p_brand, sha256(coalesce(strlen(CAST(p_partkey AS VARCHAR)) || ':' || CAST(p_partkey AS VARCHAR), '-:') || coalesce(strlen(p_name) || ':' || p_name, '-:')) AS r FROM part),
       k AS (SELECT p_brand, r[1:4] AS k, sha256(string_agg(r, ',' ORDER BY r)) AS d, count(*) AS n FROM r GROUP BY 1, 2)
       SELECT p_brand, sha256(string_agg(d, ',' ORDER BY k)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY p_brand"""
)
def fingerprints(spark, sf_dir):
    """One digest of each group's rows, whatever their order."""
    return A.fingerprint(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey", "p_name"])


@query("SELECT p_size % 5 AS rate, list(p_partkey ORDER BY p_partkey) AS members, count(*) AS n FROM part GROUP BY p_size % 5, p_partkey // 10000")
def rate_groups(spark, sf_dir):
    """Members by rate."""
    p = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("rate"), "p_partkey")
    return A.rate_groups(p, "rate", "p_partkey")


@query("SELECT l_partkey, CAST(sum(l_linenumber) AS BIGINT) AS v, CAST(min(l_linenumber) AS INTEGER) AS first_frame, CAST(max(l_linenumber) AS INTEGER) AS last_frame FROM lineitem GROUP BY l_partkey")
def scatter_add(spark, sf_dir):
    """Values added up by key, and spans."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_linenumber").alias("v"), "l_linenumber")
    return K.unsharded(li, ["l_partkey"], "v").join(A.spans(li, ["l_partkey"], "l_linenumber"), "l_partkey")


# ---- partitions and draws


@query(
    f"""WITH c AS (SELECT conv_id, turn AS view, turn % 4 + 1 AS blocks, conv_id % 2 = 0 AS iso FROM conversations),
        n AS (SELECT *, CASE WHEN iso THEN blocks ELSE min(blocks) OVER (PARTITION BY conv_id) END AS n, CASE WHEN iso THEN CAST(view AS VARCHAR) ELSE '' END AS own FROM c)
        SELECT conv_id, view, blocks, CASE WHEN n > 1 AND {unit_sql("cut", "conv_id", "own")} < 0.5 THEN 1 + CAST(floor({unit_sql("cut at", "conv_id", "own")} * (n - 1)) AS BIGINT) ELSE 0 END AS cut FROM n"""
)
def clean_cut(spark, sf_dir):
    """First supervised block: one per joint document, one per view of an isolated one."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("view"), (F.col("turn") % 4 + 1).alias("blocks"), (F.col("conv_id") % 2 == 0).alias("iso"))
    return D.clean_cut(c, ["conv_id"], "view", "blocks", "iso", 0.5).select("conv_id", "view", "blocks", "cut")


@query(
    "WITH d AS (SELECT doc_id, n_chars - 300 AS slack FROM documents WHERE n_chars >= 300), b AS (SELECT doc_id, list_sort(["
    + ", ".join(f"CAST(floor({unit_sql(f'segments/{i}', 'doc_id')} * (slack + 1)) AS BIGINT)" for i in range(3))
    + "]) AS b FROM d) SELECT doc_id, i AS segment, b[i + 1] + 100 * i AS start, b[i + 1] + 100 * (i + 1) AS stop FROM (SELECT doc_id, b, unnest(range(0, 3)) AS i FROM b)"
)
def segments(spark, sf_dir):
    """Three segments of each document that do not overlap."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return D.segments(d, ["doc_id"], "n_chars", F.lit(100), 3).select("doc_id", "segment", "start", "stop")


@query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, [n_chars % 60 + 4, n_chars % 23 + 4] AS ends, greatest(n_chars % 60 + 4, n_chars % 23 + 4) AS total FROM documents),
        ok(doc_id, total, ends, p) AS (SELECT doc_id, total, ends, total FROM d UNION
            SELECT doc_id, total, ends, q FROM (SELECT doc_id, total, ends, p - s AS q FROM ok, (SELECT unnest(range(2, 10)) AS s)) WHERE q = 0 OR (q > 0 AND len(list_filter(ends, lambda e: q < e AND q >= least(e - 2, e - 1))) = 0)),
        good AS (SELECT doc_id, total, list(p) AS good FROM ok GROUP BY doc_id, total),
        walk AS (SELECT doc_id, total, good, CAST(0 AS BIGINT) AS place, 0 AS i, CAST([] AS BIGINT[]) AS sizes FROM good UNION ALL
            SELECT doc_id, total, good, place + s, i + 1, list_append(sizes, s) FROM (SELECT *, options[CAST(floor(u * len(options)) AS BIGINT) + 1] AS s
                FROM (SELECT *, list_filter(range(2, 10), lambda x: list_contains(good, place + x)) AS options, {unit_sql("plan", "doc_id", "i")} AS u FROM walk WHERE place < total)))
        SELECT doc_id, sizes, CAST(total AS INTEGER) AS latents FROM walk WHERE place = total"""
)
def partition_plan(spark, sf_dir):
    """Joint block sizes of documents, drawn so that every view's end falls well."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 60 + 4).alias("a"), (F.col("n_chars") % 23 + 4).alias("b"))
    tail = lambda n: F.struct(F.col(n).alias("latents"), (F.col(n) - 2).alias("requested"))
    return D.plan_blocks(d.select("doc_id", F.array(tail("a"), tail("b")).alias("tails")), ["doc_id"], "tails", 2, 9).select("doc_id", "sizes", F.size(D.block_ids("sizes")).alias("latents"))


@query(
    f"""WITH RECURSIVE g AS (SELECT doc_id, CAST(n_chars % 40 + 1 AS BIGINT) AS n, CAST(n_chars % 40 + 1 AS BIGINT) AS rest, 0 AS i, CAST([] AS BIGINT[]) AS sizes FROM documents UNION ALL
            SELECT doc_id, n, rest - s, i + 1, list_append(sizes, s) FROM (SELECT *, least(2, rest) + CAST(floor({unit_sql("groups", "doc_id", "i")} * (least(4, rest) - least(2, rest) + 1)) AS BIGINT) AS s FROM g WHERE rest > 0))
        SELECT doc_id, n, sizes FROM g WHERE rest = 0"""
)
def group_plan(spark, sf_dir):
    """Drawn groups of source blocks with a shorter rest."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 40 + 1).cast("long").alias("n"))
    return D.plan_groups(d, ["doc_id"], "n", 2, 4)


_PUSH = "sqrt(-2 * ln(1 - {u})) * cos(2 * pi() * {v}) * (2.0 / 6)"


@query(
    f"""WITH RECURSIVE w AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, CAST(0 AS BIGINT) AS step, CAST(floor({unit_sql("walk/view", "p_partkey")} * 12) AS BIGINT) AS view, CAST(0 AS BIGINT) AS frame, 0.0::DOUBLE AS v, 0.0::DOUBLE AS f FROM part UNION ALL
            SELECT p_partkey, n, step + 1, ((view + CAST(round_even(nv, 0) AS BIGINT)) % 12 + 12) % 12, (frame + CAST(round_even(least(greatest(nf, 1.0), 1.0), 0) AS BIGINT)) % n, nv, nf
            FROM (SELECT *, least(greatest((v + {_PUSH.format(u=unit_sql("walk/u", "p_partkey", "step // 20"), v=unit_sql("walk/v", "p_partkey", "step // 20"))}) * 0.8, -3.0), 3.0) AS nv,
                            least(greatest((f + {_PUSH.format(u=unit_sql("walk/frames/u", "p_partkey", "step // 20"), v=unit_sql("walk/frames/v", "p_partkey", "step // 20"))}) * 0.8, -3.0), 3.0) AS nf FROM w WHERE step + 1 < n))
        SELECT p_partkey, step, view, frame FROM w"""
)
def momentum_walk(spark, sf_dir):
    """Smooth walks over a ring of views, a frame a step."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("n"))
    return D.momentum_walk(p, ["p_partkey"], "n", 12, "n").select("p_partkey", "step", "view", "frame")


@query(
    """WITH p AS (SELECT conv_id, turn AS latent, turn // 2 AS block, true AS valid, 0 AS view FROM conversations UNION ALL SELECT conv_id, turn, CASE WHEN conv_id % 10 = 3 THEN turn ELSE turn // 2 END, true, 1 FROM conversations),
       joint AS (SELECT DISTINCT conv_id, unnest([0, 1]) AS view FROM (SELECT conv_id, latent FROM p GROUP BY ALL HAVING min(block) <> max(block))),
       size AS (SELECT DISTINCT conv_id, view FROM (SELECT *, max(block) OVER (PARTITION BY conv_id, view) AS top FROM (SELECT conv_id, view, block, count(*) AS n FROM p GROUP BY ALL)) WHERE (n < 2 AND block < top) OR n > 3)
       SELECT conv_id, CAST(view AS BIGINT) AS view, 'joint' AS rule FROM joint UNION ALL SELECT conv_id, CAST(view AS BIGINT), 'size' FROM size"""
)
def plan_violations(spark, sf_dir):
    """Rules that a block plan breaks."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("latent"), F.lit(True).alias("valid"))
    half = F.floor(F.col("latent") / 2)
    a = c.withColumns({"view": F.lit(0).cast("long"), "block": half})
    b = c.withColumns({"view": F.lit(1).cast("long"), "block": F.when(F.col("conv_id") % 10 == 3, F.col("latent")).otherwise(half)})
    return D.plan_violations(a.unionByName(b), ["conv_id"], "view", "latent", "block", "valid", 2, 3)


# ---- geometry and scalars


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
       a AS (SELECT vec_id, v[1] AS x, v[2] AS y, v[3] AS z, v[4] AS tx, v[5] AS ty, v[6] + 5 AS tz, v[7] AS px, v[8] AS py, v[9] AS pz, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS t FROM e),
       k AS (SELECT *, CASE WHEN t < 0.001 THEN 1 - t * t / 6 ELSE sin(t) / t END AS s, CASE WHEN t < 0.001 THEN 0.5 - t * t / 24 ELSE (1 - cos(t)) / (t * t) END AS c FROM a),
       r AS (SELECT *, (1 - c * (y * y + z * z)) * px + (c * x * y - s * z) * py + (c * x * z + s * y) * pz + tx AS qx,
                       (c * x * y + s * z) * px + (1 - c * (x * x + z * z)) * py + (c * y * z - s * x) * pz + ty AS qy,
                       (c * x * z - s * y) * px + (c * y * z + s * x) * py + (1 - c * (x * x + y * y)) * pz + tz AS qz FROM k)
       SELECT vec_id, round(500 * qx / qz + 320, 4) AS u, round(500 * qy / qz + 240, 4) AS v, round(qz, 6) AS depth FROM r"""
)
def pose_project(spark, sf_dir):
    """Points seen through cameras with rotation vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    v = lambda i: F.col("v")[i]
    # each step is a column of its own, so that it is computed once
    e = e.select("vec_id", X.rodrigues(v(0), v(1), v(2)).alias("r"), F.array(v(3), v(4), v(5) + 5).alias("t"), F.array(v(6), v(7), v(8)).alias("x"))
    e = e.withColumn("p", X.projected(F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0), F.col("r"), F.col("t"), F.col("x")))
    p = F.col("p")
    return e.select("vec_id", F.round(p["u"], 4).alias("u"), F.round(p["v"], 4).alias("v"), F.round(p["depth"], 6).alias("depth"))


@query(
    """WITH s AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS x FROM orders)
       SELECT o_orderkey, round(3 * x / (1 + 2 * x), 9) AS sigma, round((1 - x) * 2.0 + x * 0.5, 9) AS noised, round(exp(-2 * pow((o_orderkey % 1000 - 500) / 1000.0::DOUBLE, 2)), 9) AS weight, CAST(round_even(x * 10, 0) AS BIGINT) AS even, (o_orderkey - 50) % 7 + CASE WHEN (o_orderkey - 50) % 7 < 0 THEN 7 ELSE 0 END AS wrapped, least(greatest(o_orderkey % 100, 20), 80) AS clamped, lcm(o_orderkey % 12 + 1, 8) AS multiple FROM s"""
)
def scalar_functions(spark, sf_dir):
    """Flow schedule, rounding, clamping, modulus."""
    k = F.col("o_orderkey")
    x = (k % 100) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(X.shift_sigma(x, 3.0), 9).alias("sigma"),
        F.round(X.noised(F.lit(2.0), F.lit(0.5), x), 9).alias("noised"),
        F.round(X.gaussian_weight(k % 1000, 1000), 9).alias("weight"),
        X.half_even(x * 10).alias("even"),
        X.wrap(k - 50, 7).alias("wrapped"),
        X.clamp(k % 100, 20, 80).alias("clamped"),
        X.lcm(k % 12 + 1, F.lit(8)).alias("multiple"),
    )


@query("SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS stripped, 'docs/' || source AS parent, source || '_' || doc_id AS stem FROM documents")
def string_functions(spark, sf_dir):
    """Stripping and path functions."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("docs/./x/../"), "source", F.lit("//"), "source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".mp4"))
    full = X.normal_path(path)
    return d.select("doc_id", F.md5(X.strip("text")).alias("stripped"), F.regexp_extract(full, "^(.*)/[^/]*$", 1).alias("parent"), X.stem(full).alias("stem"))
