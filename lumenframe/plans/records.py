"""Queries on paths, lists, texts, retention, caches, shards and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import filters as P
from ..operators import joins as J
from ..operators import packing as K
from ..operators import sampling as S
from ..operators import timebase as T
from ..sources import manifests, sinks
from .registry import query, table, unit_sql


@query("SELECT c_custkey, camera, printf('cam_%06d.mp4', camera) AS path FROM (SELECT c_custkey, CAST(unnest(range(0, c_custkey % 4)) AS INTEGER) AS camera FROM customer)")
def camera_paths(spark, sf_dir):
    """One path per camera from a template."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("n"))
    return manifests.camera_paths(c, "cam_%06d.mp4", "n").drop("n")


@query(
    """SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN '/abs/' || s_name || '.mp4' WHEN 1 THEN '/root/' || s_name || '.mp4' WHEN 2 THEN '/root/' || s_name || '.avi' WHEN 3 THEN NULL ELSE '/root/d/' END AS path FROM supplier"""
)
def resolved_paths(spark, sf_dir):
    """Paths under their root, with a suffix where there is none."""
    k, n = F.col("s_suppkey") % 5, F.col("s_name")
    raw = F.when(k == 0, F.concat(F.lit("/abs/"), n, F.lit(".mp4"))).when(k == 1, n).when(k == 2, F.concat(n, F.lit(".avi"))).when(k == 3, F.lit("  ")).otherwise(F.lit("d/"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", manifests.resolved_path(raw, F.lit("/root/")).alias("path"))


@query(
    """WITH c AS (SELECT conv_id, list(CASE WHEN turn % 5 = 4 THEN ' ' ELSE role || '/' || turn END ORDER BY turn) AS p FROM conversations GROUP BY conv_id)
       SELECT conv_id, len(p) >= 3 AND len(list_filter(p[1:3], lambda x: trim(x) = '')) = 0 AS three, len(p) >= 5 AND len(list_filter(p[1:5], lambda x: trim(x) = '')) = 0 AS five FROM c"""
)
def complete_paths(spark, sf_dir):
    """Whether the paths of the first views are all there."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, " ").otherwise(F.concat_ws("/", "role", F.col("turn").cast("string"))).alias("p"))
    c = K.gathered_views(c, ["conv_id"], "turn", ["p"])
    return c.select("conv_id", P.complete_paths("p", F.lit(3)).alias("three"), P.complete_paths("p", F.lit(5)).alias("five"))


@query(
    """WITH c AS (SELECT conv_id, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
       SELECT conv_id, CAST(list_sum(t[1:3]) AS BIGINT) AS head, greatest(1, CAST(floor(len(t) * 3 / 7.0) AS BIGINT)) AS captions FROM c"""
)
def prefix_truncation(spark, sf_dir):
    """Lists cut to a prefix, and the captions that stay in proportion."""
    c = K.gathered_views(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("t")), ["conv_id"], "turn", ["t"])
    return c.select("conv_id", F.aggregate(P.truncated("t", F.lit(3)), F.lit(0).cast("long"), lambda a, x: a + x).alias("head"), P.scaled_count("views", F.lit(3), F.lit(7)).alias("captions"))


@query("SELECT o_orderkey, least(greatest(CASE WHEN i < 0 THEN i + 50 ELSE i END, 0), 49) AS clipped FROM (SELECT o_orderkey, o_custkey % 160 - 80 AS i FROM orders)")
def clipped_index(spark, sf_dir):
    """Indices from the end, kept inside the list."""
    return table(spark, sf_dir, "orders").select("o_orderkey", T.clip_index(F.col("o_custkey") % 160 - 80, F.lit(50)).alias("clipped"))


@query(
    f"""SELECT o_orderkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN dyn AND u < 0.5 THEN b ELSE a END AS text
        FROM (SELECT o_orderkey, nullif(trim(CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END), '') AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS b, o_orderkey % 2 = 0 AS dyn, {unit_sql("text", "o_orderkey")} AS u FROM orders)"""
)
def text_choice(spark, sf_dir):
    """Which of two texts is used, by presence and a draw."""
    k = F.col("o_orderkey")
    a, b = F.when(k % 5 == 0, " ").otherwise(F.col("o_orderpriority")), F.when(k % 7 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.chosen_text(a, b, k % 2 == 0, X.unit("o_orderkey", salt="text")).alias("text"))


@query("SELECT vec_id, round(list_sum(CASE WHEN label % 3 = 0 THEN v ELSE list_transform(v, lambda x: x * (label % 3 + 1)) END), 6) AS s FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[])[1:4] AS v FROM embeddings)")
def restored_scale(spark, sf_dir):
    """Translations in their recorded scale; scale 1 leaves them as they are."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("v"))
    out = P.restored_scale(F.col("v"), (F.col("label") % 3 + 1).cast("double"))
    return e.select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("SELECT step, step IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 DESC LIMIT 5) OR step IN (1, 7) AS kept FROM (SELECT DISTINCT o_custkey AS step FROM orders)")
def retention(spark, sf_dir):
    """Generations that stay: the newest five, and those protected."""
    return sinks.retained(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("step")).distinct(), "step", 5, [1, 7])


@query("SELECT l_partkey AS key, CAST(min(l_linenumber) AS INTEGER) AS publisher FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) GROUP BY 1")
def cache_writes(spark, sf_dir):
    """Keys to publish that a cache lacks, each by one rank."""
    need = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("rank"))
    return sinks.cache_writes(need, "key", "rank", table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("key")))


@query("SELECT key, CASE WHEN shard IS NULL THEN 'extra' WHEN there IS NULL THEN 'missing' WHEN shard <> there THEN 'misplaced' END AS fault FROM (SELECT p_partkey AS key, p_partkey % 7 AS shard FROM part WHERE p_partkey % 10 <> 0) FULL JOIN (SELECT p_partkey AS key, CASE WHEN p_partkey % 50 = 3 THEN 99 ELSE p_partkey % 7 END AS there FROM part WHERE p_partkey % 11 <> 0) USING (key) WHERE shard IS DISTINCT FROM there")
def index_faults(spark, sf_dir):
    """Keys that an index and its shards disagree on."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    k = F.col("key")
    return manifests.index_faults(p.where(k % 10 != 0).withColumn("shard", k % 7), p.where(k % 11 != 0).withColumn("shard", F.when(k % 50 == 3, F.lit(99)).otherwise(k % 7)))


@query(
    """WITH a AS (SELECT c_custkey AS k, c_nationkey AS v, c_mktsegment AS w FROM customer WHERE c_custkey % 9 <> 0), b AS (SELECT c_custkey AS k2, CASE WHEN c_custkey % 4 = 1 THEN c_nationkey + 1 ELSE c_nationkey END AS v2, CASE WHEN c_custkey % 5 = 2 THEN 'Z' ELSE c_mktsegment END AS w2 FROM customer WHERE c_custkey % 8 <> 0)
       SELECT coalesce(k, k2) AS k, CASE WHEN k2 IS NULL THEN 'new' WHEN k IS NULL THEN 'gone' WHEN v <> v2 THEN 'stale' WHEN w <> w2 THEN 'allowed' ELSE 'same' END AS status FROM a FULL JOIN b ON k = k2"""
)
def state_changes(spark, sf_dir):
    """A saved state against the present, with one column that may change."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    now = c.where(k % 9 != 0).select(k.alias("k"), F.col("c_nationkey").alias("v"), F.col("c_mktsegment").alias("w"))
    old = c.where(k % 8 != 0).select(k.alias("k"), F.when(k % 4 == 1, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("v"), F.when(k % 5 == 2, "Z").otherwise(F.col("c_mktsegment")).alias("w"))
    return J.changed_since(now, old, "k", [], ["w"])


@query(f"SELECT c_custkey, CASE WHEN n > 1 AND {unit_sql('condition', 'c_custkey')} < 0.4 THEN 1 + CAST(floor({unit_sql('length', 'c_custkey')} * (n - 1)) AS BIGINT) ELSE 0 END AS length, round(least(greatest(sqrt(-2 * ln(1 - {unit_sql('ring/u', 'c_custkey')})) * cos(2 * pi() * {unit_sql('ring/v', 'c_custkey')}), -2.0), 2.0), 6) AS jitter FROM (SELECT c_custkey, c_custkey % 9 AS n FROM customer)")
def keyed_draws(spark, sf_dir):
    """Conditioning lengths and clipped normal jitter, by key."""
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 9).alias("n"))
    return c.select("c_custkey", S.condition_length("n", 0.4, "c_custkey").alias("length"), F.round(X.normal_draw("c_custkey", salt="ring", limit=2.0), 6).alias("jitter"))


@query("SELECT o_orderkey // 100 AS step, 'loss' AS name, CAST(max(o_totalprice) AS DOUBLE) AS value FROM orders GROUP BY 1")
def metric_history(spark, sf_dir):
    """Numeric metrics, routed from values given as text."""
    o = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("step")).agg(F.max("o_totalprice").cast("string").alias("value"))
    rows = o.select("step", F.lit("loss").alias("name"), "value").unionByName(o.select("step", F.lit("note").alias("name"), F.lit("text").alias("value")))
    return sinks.routed(rows, "name", "value", "step")[0]


@query("SELECT p_partkey, tile, round(greatest(0.0, least(1.0, (p_size * 3 - 32 * tile) / 32.0)), 9)::DOUBLE AS weight FROM (SELECT p_partkey, p_size, unnest(range(0, 5)) AS tile FROM part)")
def edge_weights(spark, sf_dir):
    """Share of each tile that lies inside the picture."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("tile"))
    return p.select("p_partkey", "tile", F.round(K.tile_weight(F.col("p_size") * 3, "tile"), 9).alias("weight"))


@query(
    f"""SELECT o_orderkey, CAST(round_even(o_custkey * 0.5, 0) AS BIGINT) AS even, (o_custkey - 700) % 11 + CASE WHEN (o_custkey - 700) % 11 < 0 THEN 11 ELSE 0 END AS wrapped, {unit_sql("sql", "o_orderkey")} AS u,
               17 * greatest(0, CAST(ceil((o_custkey + 1 - 4) / 17.0) AS BIGINT)) + 5 AS padded, least(CAST(round_even((o_custkey % 300) * (149 / 299.0::DOUBLE), 0) AS BIGINT), 149) AS pose FROM orders"""
)
def sql_functions(spark, sf_dir):
    """The SQL entry point: SQL functions over a view, inlined by the optimizer."""
    from ..functions.sql import register

    register(spark, sf_dir, ["orders"])
    return spark.sql(
        """SELECT o_orderkey, half_even(o_custkey * 0.5D) AS even, wrap_index(o_custkey - 700, 11) AS wrapped, unit_draw('sql', CAST(o_orderkey AS STRING)) AS u,
                  padded_frames(o_custkey + 2) AS padded, pose_index(o_custkey % 300, 300, 150) AS pose FROM orders"""
    )
