"""Connected components, and names for helper columns. Intermediate tables are those of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, saved, scratch, unused  # noqa: F401


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; the component's name is its least node.

    Alternating large-star and small-star steps: each links nodes to the least node of
    their neighbourhood, until nothing changes. The rounds grow with the logarithm of a
    component's size. Edges stay in tables; the driver sees a count and a checksum.
    """
    u, v = F.col("u"), F.col("v")
    now = saved(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        # a table of its own: a join with it can split the many rows of a hub
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(m.select("u", F.col("m").alias("v"))).distinct())
        dropped(now)
        dropped(least)
        now = after
        r = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == (r.n, r.s):
            break
        mark = (r.n, r.s)
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
