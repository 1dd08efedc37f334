"""Queries on column functions: flow steps, colour, prompts, intrinsics, grids, cuts and epochs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..functions.sql import register
from ..operators import filters as P
from ..operators import packing as K
from ..operators import partitioning as D
from ..operators import sampling as S
from .registry import query, table


@query("SELECT o_orderkey, round(z + s * v, 9) AS clean, round(z + (s - s / 2) * v, 9) AS stepped FROM (SELECT o_orderkey, (o_orderkey % 7) / 7.0::DOUBLE AS z, (o_custkey % 5 - 2) / 5.0::DOUBLE AS v, (o_orderkey % 100) / 100.0::DOUBLE AS s FROM orders)")
def flow_steps(spark, sf_dir):
    """Clean estimates and Euler steps of a flow."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 / F.lit(7.0)).alias("z"), ((F.col("o_custkey") % 5 - 2) / F.lit(5.0)).alias("v"), (F.col("o_orderkey") % 100 / F.lit(100.0)).alias("s"))
    return o.select("o_orderkey", F.round(X.clean_estimate("z", "v", "s"), 9).alias("clean"), F.round(X.euler_step("z", "v", "s", F.col("s") / 2), 9).alias("stepped"))


@query(f"SELECT l_orderkey, l_linenumber, round({X.LUMA[0]} * (l_partkey % 256) + {X.LUMA[1]} * (l_suppkey % 256) + {X.LUMA[2]} * (l_orderkey % 256), 6)::DOUBLE AS luma FROM lineitem")
def luma(spark, sf_dir):
    """Brightness of colours."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.luma(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256), 6).alias("luma"))


@query(
    """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role ELSE role || chr(10) || '[CHUNK]' || coalesce(text, '') END AS p FROM conversations),
       a AS (SELECT *, position(chr(10) || '[CHUNK]' IN p) AS at_ FROM p)
       SELECT conv_id, turn, md5(CASE WHEN at_ > 0 THEN substr(p, 1, at_ - 1) ELSE p END) AS scene, md5(CASE WHEN at_ > 0 THEN substr(p, at_ + 8) ELSE p END) AS motion FROM a"""
)
def prompt_parts(spark, sf_dir):
    """Scene and motion of prompts that have a mark between them."""
    c = table(spark, sf_dir, "conversations")
    p = F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.concat("role", F.lit("\n[CHUNK]"), F.coalesce("text", F.lit(""))))
    both = c.select("conv_id", "turn", X.scene_and_motion(p).alias("s"))
    return both.select("conv_id", "turn", F.md5("s.scene").alias("scene"), F.md5("s.motion").alias("motion"))


@query(
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
       SELECT vec_id, i AS frame, round(list_sum(v[10 * i + 1 : 10 * i + 10]), 6) AS total, round(500 / (640.0 + i), 9)::DOUBLE AS fx, round(240 / 480.0, 9)::DOUBLE AS cy FROM (SELECT *, unnest(range(0, len(v) // 10)) AS i FROM e)"""
)
def pose_rows(spark, sf_dir):
    """Flat lists of poses as rows of ten numbers, with intrinsics in units of the image."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = e.select("vec_id", F.posexplode(X.pose_rows("v")).alias("frame", "row"))
    k = X.normal_intrinsics(F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0), 640.0 + F.col("frame"), F.lit(480.0))
    total = F.aggregate("row", F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.col("frame").cast("long").alias("frame"), F.round(total, 6).alias("total"), F.round(k[0], 9).alias("fx"), F.round(k[3], 9).alias("cy"))


@query(
    """WITH p AS (SELECT p_partkey, 2 * (p_size % 6 + 1) AS h, 2 * (p_partkey % 5 + 1) AS w FROM part),
       g AS (SELECT *, sqrt(CAST(h * w AS DOUBLE)) AS area FROM p),
       c AS (SELECT *, unnest(range(0, (h // 2) * (w // 2))) AS place FROM g)
       SELECT p_partkey, place, round(((1 - h / area) / 2 + (place // (w // 2)) * (h / area / (h // 2))) * 32, 6) AS y, round(((1 - w / area) / 2 + (place % (w // 2)) * (w / area / (w // 2))) * 32, 6) AS x FROM c"""
)
def spatial_grid(spark, sf_dir):
    """Positions of the patches of a grid, the same area for every aspect."""
    p = table(spark, sf_dir, "part").select("p_partkey", (2 * (F.col("p_size") % 6 + 1)).alias("h"), (2 * (F.col("p_partkey") % 5 + 1)).alias("w"))
    each = p.select("p_partkey", F.posexplode(K.spatial_grid("h", "w")).alias("place", "g"))
    return each.select("p_partkey", F.col("place").cast("long").alias("place"), F.round("g.y", 6).alias("y"), F.round("g.x", 6).alias("x"))


@query(
    """WITH g AS (SELECT p_partkey, 2 * (p_size % 6) + p_partkey % 2 AS h, p_partkey % 11 AS w FROM part),
       r AS (SELECT *, unnest(range(0, h // 2 * 2)) AS r FROM g), c AS (SELECT *, unnest(range(0, w // 2 * 2)) AS c FROM r)
       SELECT p_partkey, CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, CAST(4 * ((r // 2) * (w // 2) + c // 2) + 2 * (r % 2) + c % 2 AS BIGINT) AS place FROM c"""
)
def patch_order(spark, sf_dir):
    """Pixels of every part's grid, each of a size of its own, in the order of its 2 x 2 patches."""
    p = table(spark, sf_dir, "part").select("p_partkey", (2 * (F.col("p_size") % 6) + F.col("p_partkey") % 2).alias("h"), (F.col("p_partkey") % 11).alias("w"))
    return p.select("p_partkey", F.inline(K.patch_places("h", "w")))


@query(
    """SELECT o_orderkey, least(o_orderkey % 6 + 1, o_custkey % 4) AS cut, o_orderkey // 1000 AS epoch, o_orderkey % 1000 AS row,
              CASE WHEN o_custkey % 9 > 0 THEN least(o_orderkey % 50, o_custkey % 40, 30) END AS frames FROM orders"""
)
def cuts_and_epochs(spark, sf_dir):
    """Cuts moved on by a block, running indices as epochs, and the least of a row's frame counts."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    epoch, row = S.epoch_of(k, 1000)
    counts = F.when(c % 9 > 0, F.array(k % 50, c % 40, F.lit(30).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.promoted(k % 6, c % 4 + 1).alias("cut"), epoch.alias("epoch"), row.alias("row"), P.least_frames(counts).alias("frames"))


@query(
    """WITH r AS (SELECT p_brand, p_retailprice AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
       SELECT p_brand, round(avg(v), 9) AS price FROM r WHERE i >= n // 10 AND i < n - n // 10 GROUP BY p_brand"""
)
def trimmed_means(spark, sf_dir):
    """An aggregate function of our own, from SQL."""
    register(spark, sf_dir, ["part"])
    return spark.sql("SELECT p_brand, round(trimmed_mean(p_retailprice), 9) AS price FROM part GROUP BY p_brand")
