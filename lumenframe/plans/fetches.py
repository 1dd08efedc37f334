"""Queries on indices of containers, plans for fetching frames, physical rows and packed canvases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gather as G
from ..operators import joins as J
from ..operators import packing as K
from ..sources import containers as C
from ..sources import archives as A
from ..sources import manifests as M
from ..sources import sinks as W
from ..streaming.events import new_root
from ..tables import parts
from .registry import query, table


@query(
    """WITH n AS (SELECT s_suppkey, 1 + count(l_suppkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey)
       SELECT s_suppkey, CAST(16 * (1 + s_suppkey % 100) AS INTEGER) AS width, CAST(8 * (1 + s_suppkey % 50) AS INTEGER) AS height, n AS n_frames, CAST(512 AS BIGINT) AS frame_ticks, 25.0::DOUBLE AS fps,
              CAST(ceil(n / 12.0) AS BIGINT) AS n_keyframes, (n - 1) // 12 * 12 AS last_keyframe, (n - 1) // 12 * 12 * 512 AS last_keyframe_ticks, true AS small FROM n"""
)
def container_index(spark, sf_dir):
    """Containers with a frame for each line of a supplier, and some with a sample without length behind: their indices, read without the payload."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey").join(lines, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    n = 1 + F.coalesce("lines", F.lit(0))
    run = lambda n, t: F.struct(n.cast("long").alias("n"), F.lit(t).cast("long").alias("ticks"))
    runs = F.when(F.col("s_suppkey") % 2 == 1, F.array(run(n, 512), run(F.lit(1), 0))).otherwise(F.array(run(n, 512)))
    rows = s.select(
        F.format_string("%012d.mp4", "s_suppkey").alias("name"), (16 * (1 + F.col("s_suppkey") % 100)).cast("long").alias("width"), (8 * (1 + F.col("s_suppkey") % 50)).cast("long").alias("height"),
        F.lit(12_800).cast("long").alias("timescale"), runs.alias("runs"), F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.lit(12).cast("long")).alias("keyframes"), F.lit(50_000).cast("long").alias("payload"),
    )
    folder = new_root(spark)
    C.write_containers(rows, folder)
    i = C.container_index(spark, folder)
    return i.select(
        F.regexp_extract("path", r"(\d+)\.mp4$", 1).cast("long").alias("s_suppkey"), "width", "height", "n_frames", "frame_ticks", "fps", F.size("keyframes").cast("long").alias("n_keyframes"),
        F.element_at("keyframes", -1).alias("last_keyframe"), F.element_at("keyframe_ticks", -1).alias("last_keyframe_ticks"), (F.col("bytes_read") * 10 < F.col("bytes")).alias("small"),
    )


_WANTED = """r AS (SELECT l_orderkey, o_custkey, list_sort(list(l_partkey % 500 - 100)) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
       c AS (SELECT c_custkey, c_custkey % 300 AS n, 5 + c_custkey % 20 AS k FROM customer),
       e AS (SELECT l_orderkey, o_custkey, n, k, unnest(f) AS x, unnest(range(0, len(f))) AS place FROM r JOIN c ON c_custkey = o_custkey WHERE n > 0),
       w AS (SELECT l_orderkey, o_custkey, place, k, (greatest(least(x, n - 1), -n) % n + n) % n AS frame FROM e)"""


def _requests(spark, sf_dir):
    """Frames that an order's lines want of its customer's clip, some negative or beyond the end."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 500 - 100).alias("frame"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = lines.repartition(parts(lines), "l_orderkey")  # the join and the grouping keep it
    asked = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_custkey").agg(F.array_sort(F.collect_list("frame")).alias("frames"))
    c, n = table(spark, sf_dir, "customer"), F.col("c_custkey") % 300
    keys = F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)), 5 + F.col("c_custkey") % 20))
    clips = c.select(F.col("c_custkey").alias("o_custkey"), n.alias("n_frames"), F.lit(512).cast("long").alias("frame_ticks"), keys.alias("keyframes"))
    return G.wanted_frames(asked, ["l_orderkey"], "o_custkey", "frames", clips)


@query(
    f"""WITH {_WANTED},
       g AS (SELECT l_orderkey, o_custkey, frame // k * k AS seek, max(frame) AS last, count(DISTINCT frame) AS n_wanted FROM w GROUP BY ALL),
       s AS (SELECT *, sum(CASE WHEN seek - p - 1 <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY seek) - 1 AS step FROM (SELECT *, lag(last) OVER (PARTITION BY l_orderkey ORDER BY seek) AS p FROM g))
       SELECT l_orderkey, o_custkey, CAST(step AS BIGINT) AS step, min(seek) AS seek, max(last) AS last, CAST(sum(n_wanted) AS BIGINT) AS n_wanted, max(last) - min(seek) + 1 AS n_decoded FROM s GROUP BY l_orderkey, o_custkey, step"""
)
def frame_gather(spark, sf_dir):
    """Seeks and decoded ranges of every request: one a keyframe interval, near ones joined."""
    return G.gather_plan(_requests(spark, sf_dir), ["l_orderkey"], "o_custkey", seek_cost=3)


@query(f"WITH {_WANTED} SELECT l_orderkey, place, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY frame) - 1 AS slot FROM w")
def frame_slots(spark, sf_dir):
    """Which of its distinct frames each place of a request gets."""
    return G.gather_slots(_requests(spark, sf_dir), ["l_orderkey"])


@query("SELECT doc_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def row_lookup(spark, sf_dir):
    """Texts of the toxic documents, by physical row: their ids are found in a scan without texts, and only their row groups' texts are read."""
    ids = M.with_row_ids(table(spark, sf_dir, "documents").select("doc_id", "_metadata"), "row_id").select("doc_id", "file_name", "row_id")
    toxic = ids.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    rows = M.rows_at(spark, f"{sf_dir}/documents.parquet", toxic, ["doc_id", "text"])
    return rows.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


@query(
    """WITH l AS (SELECT * FROM (VALUES (0, 0, 0, 4, 4), (1, 4, 0, 2, 2), (2, 2, 2, 6, 6), (3, 6, 5, 2, 2)) t(view, x, y, w, h)),
       v AS (SELECT vec_id, view, flatten([list_slice(embedding, r * 8 + x + 1, r * 8 + least(x + w, 8)) FOR r IN range(y, least(y + h, 8))]) AS p, least(y + h, 8) - y AS view_height, least(x + w, 8) - x AS view_width FROM embeddings, l)
       SELECT vec_id, CAST(view AS BIGINT) AS view, CAST(view_height AS BIGINT) AS view_height, CAST(view_width AS BIGINT) AS view_width, CAST(len(p) AS BIGINT) AS n, CAST(p[1] AS DOUBLE) AS first, CAST(p[len(p)] AS DOUBLE) AS last,
              md5(array_to_string([CAST(CAST(floor(1000 * CAST(x AS DOUBLE)) AS BIGINT) AS VARCHAR) FOR x IN p], ',')) AS digest FROM v"""
)
def untiled_views(spark, sf_dir):
    """Vectors as packed canvases of 8 by 8: four views of unequal sizes cut out of each."""
    layout = spark.createDataFrame([(0, 0.5, 0.0, 0.0), (1, 0.25, 0.5, 0.0), (2, 0.75, 0.25, 0.25), (3, 0.3, 0.75, 0.65)], "view long, scale double, x double, y double")
    v = K.untiled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8, 8, layout)
    p = F.col("pixels")
    text = F.array_join(F.transform(p, lambda x: F.floor(1000 * x.cast("double")).cast("string")), ",")
    return v.select("vec_id", "view", "view_height", "view_width", F.size(p).cast("long").alias("n"), p[0].cast("double").alias("first"), F.element_at(p, -1).cast("double").alias("last"), F.md5(text).alias("digest"))


@query("SELECT s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier")
def json_manifest(spark, sf_dir):
    """A manifest in JSON lines, written and read again by its suffix, without a heavy column."""
    path = f"{new_root(spark)}/manifest.jsonl"
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.repeat("s_name", F.lit(50)).alias("heavy"))
    W.append_metrics(rows, path)
    return M.read_manifest(spark, path, rows.schema, heavy=["heavy"])


@query("SELECT o_orderpriority, count(*) AS n, CAST(2 AS BIGINT) AS step FROM orders GROUP BY o_orderpriority")
def latest_generation(spark, sf_dir):
    """Two committed generations of a report and a third that was not committed: readers see the second."""
    root, orders = new_root(spark), table(spark, sf_dir, "orders")
    for step, rows in ((1, orders.where("o_orderkey < 100")), (2, orders)):
        W.commit_generation(rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.lit(step).cast("long").alias("step")), root, step, rows="all")
    orders.limit(1).write.parquet(f"{root}/step={3:012d}")
    return W.latest(spark, root)


@query(
    """WITH b AS (SELECT o_orderkey, 1 + o_orderkey % 7 AS u FROM orders), s AS (SELECT *, sum(u) OVER (ORDER BY o_orderkey) - u AS before FROM b),
       i AS (SELECT CAST(before // 500 AS BIGINT) AS shard, count(*) AS rows, CAST(sum(u) AS BIGINT) AS units FROM s GROUP BY 1)
       SELECT shard, rows, units, count(*) OVER () AS shards FROM i"""
)
def sharded_rows(spark, sf_dir):
    """Orders written in shards of about 500 units; the index that readers go by."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("u"))
    index = W.write_shards(rows, ["o_orderkey"], "u", 500, new_root(spark))
    return index.select("shard", "rows", "units", F.lit(index.count()).cast("long").alias("shards"))


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def required_match(spark, sf_dir):
    """A join that fails on an order without a customer."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return J.required(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"]).select("o_orderkey", "c_nationkey")


@query("SELECT CAST(count(*) AS BIGINT) AS files, true AS whole, true AS trees FROM supplier")
def archived_files(spark, sf_dir):
    """A file for each supplier, archived with an index and told apart by trees of digests: every file lies where the index says."""
    folder, archive = new_root(spark), new_root(spark)
    one = F.array(F.struct(F.lit(10).cast("long").alias("n"), F.lit(512).cast("long").alias("ticks")))
    s = table(spark, sf_dir, "supplier")
    C.write_containers(s.select(F.format_string("%012d.mp4", "s_suppkey").alias("name"), (16 + F.col("s_suppkey") % 100).alias("width"), F.lit(8).cast("long").alias("height"), F.lit(100).cast("long").alias("timescale"), one.alias("runs"), F.array(F.lit(0).cast("long")).alias("keyframes"), (F.col("s_suppkey") % 5000).cast("long").alias("payload")), folder)
    files = A.files_below(spark, folder)
    index = A.write_archive(files, archive, 50_000)
    trees = A.file_trees(A.range_digests(files, 1 << 30))
    # a file of one range has the digest of its digest as the root of its tree
    both = index.join(trees, "path")
    after = F.lead("offset").over(Window.partitionBy("part").orderBy("offset"))
    both = both.withColumn("whole", F.coalesce(F.col("offset") + index["bytes"] == after, F.lit(True)) & (index["bytes"] == trees["bytes"]))
    return both.agg(F.count("*").alias("files"), F.bool_and("whole").alias("whole"), F.bool_and(F.sha2(F.col("sha256").cast("binary"), 256) == F.col("root")).alias("trees"))
