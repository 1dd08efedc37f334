"""Queries over whole tables, held to brute force besides their SQL."""

import __spark_entry__ as entry


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def intervals(key, frames):
    latents = 1 if frames == 1 else 5 * max(0, -((5 - frames) // 17)) + 2
    starts = [17 * (i // 5) + (0, 1, 5, 9, 13)[i % 5] for i in range(latents)]
    last = max((s + 3) // 20 for s in starts if s < frames)
    blocks = [min((s + 3) // 20, last) for s in starts]
    first = [i for i in range(latents) if i == 0 or blocks[i] != blocks[i - 1]]
    return [(key, run, blocks[i], starts[i], starts[first[run + 1]] if run + 1 < len(first) else frames) for run, i in enumerate(first)]


def test_block_intervals_of_every_order(spark, tmp_path):
    orders = [(i, i) for i in range(1, 302)]
    d = written(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long")
    got = sorted(tuple(r) for r in entry.queries()["block_intervals"](spark, d).select("o_orderkey", "run", "block", "start", "stop").collect())
    assert got == [row for k, c in orders for row in intervals(k, c % 150 + 1)]
    assert [r for r in got if r[0] == 150] == [(150, 0, 0, 0, 1)]


def test_block_intervals_sort_nothing(spark, data):
    plan = entry.queries()["block_intervals"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan  # a clip's runs are found in its row


def test_partitions_grow_with_the_files(spark, tmp_path, monkeypatch):
    from lumenframe import tables

    d = written(spark, tmp_path, "lineitem", [(i // 4, i % 700) for i in range(4000)], "l_orderkey long, l_partkey long")
    written(spark, tmp_path, "orders", [(i, i % 90) for i in range(1000)], "o_orderkey long, o_custkey long")
    written(spark, tmp_path, "customer", [(i,) for i in range(90)], "c_custkey long")
    few = {n: sorted(map(tuple, entry.queries()[n](spark, d).collect())) for n in ("frame_gather", "frame_slots")}
    monkeypatch.setattr(tables, "PART_BYTES", 100)
    for n, want in few.items():
        q = entry.queries()[n](spark, d)
        assert q.rdd.getNumPartitions() > 50 and sorted(map(tuple, q.collect())) == want


def test_rate_groups_and_walks_of_every_part(spark, tmp_path):
    parts = [(i, i % 7 + 1) for i in range(12_000)]
    d = written(spark, tmp_path, "part", parts, "p_partkey long, p_size int")
    rows = sorted((r.rate, r.members, r.n) for r in entry.queries()["rate_groups"](spark, d).collect())
    assert all(r[2] == len(r[1]) and r[1][0] // 10_000 == r[1][-1] // 10_000 for r in rows)
    for rate in range(5):
        assert [m for r, members, _ in rows if r == rate for m in members] == [k for k, size in parts if size % 5 == rate]
    steps = entry.queries()["momentum_walk"](spark, d).groupBy("p_partkey").count()
    assert sorted(tuple(r) for r in steps.collect()) == parts
