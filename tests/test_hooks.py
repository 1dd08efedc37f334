import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import hooks, partitioning, sampling


def test_functions_by_name_with_a_set_up(spark):
    @hooks.named("times")
    def times(b, factor):
        return pa.RecordBatch.from_arrays([pa.array([x * factor for x in b.column("id").to_pylist()])], names=["id"])

    out = hooks.mapped(spark.range(100).repartition(3), "times", "id long", setup=lambda: 3)
    assert sorted(r.id for r in out.collect()) == list(range(0, 300, 3))


def test_lists_are_zipped_where_their_lengths_match(spark):
    df = spark.createDataFrame([([1, 2], ["a", "b"]), ([1], ["a", "b"])], "x array<int>, y array<string>")
    got = [r[0] for r in df.select(hooks.zipped(["x", "y"], "null")).collect()]
    assert [tuple(z) for z in got[0]] == [(1, "a"), (2, "b")] and got[1] is None
    with pytest.raises(Exception, match="differ in length"):
        df.select(hooks.zipped(["x", "y"])).collect()


def test_observed_metrics(spark):
    df, seen = hooks.observed(spark.range(10), n=F.count("*"), top=F.max("id"))
    assert df.where("id > 3").count() == 6 and seen.get == {"n": 10, "top": 9}


def test_views_share_one_walk(spark):
    p = spark.createDataFrame([(1, 30), (2, 5)], "k long, n long")
    walk = partitioning.momentum_walk(p, ["k"], "n", 12, "n").drop("n")
    out = sampling.shared_walk(walk, p.withColumn("o", sampling.ring_offsets(F.lit(3), F.lit(12), 0.02, "k")), ["k"], 12, "o").collect()
    base = {(r.k, r.step): (r.view, r.frame) for r in walk.collect()}
    turns = {}
    for r in out:
        view, frame = base[r.k, r.step]
        assert r.frame == frame
        turns.setdefault((r.k, r.place), set()).add((r.camera - view) % 12)
    assert len(out) == 3 * 35 and all(len(t) == 1 for t in turns.values()) and turns[1, 0] == turns[2, 0] == {0}


def test_sketches_keep_their_error_bounds(spark, data):
    import __spark_entry__ as entry

    exact = {r.l_returnflag: r for r in spark.read.parquet(f"{data}/lineitem.parquet").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.percentile("l_extendedprice", 0.48).alias("lo"), F.percentile("l_extendedprice", 0.52).alias("hi")).collect()}
    for r in entry.queries()["approximate"](spark, data).collect():
        assert abs(r.parts / exact[r.l_returnflag].parts - 1) < 0.08 and exact[r.l_returnflag].lo <= r.median <= exact[r.l_returnflag].hi


def test_a_scope_deletes_its_tables(spark):
    import os

    from lumenframe.tables import saved, scratch

    with scratch():
        df = saved(spark.range(3))
        path = df._saved_path.replace("file://", "")
        assert df.count() == 3 and os.path.isdir(path)
    assert not os.path.isdir(path)
