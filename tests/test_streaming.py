"""Streams, driven over folders of Parquet files."""

from lumenframe.streaming import events as E


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_windows_match_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    s = E.event_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=1)
    got = E.run_to_end(E.tumbling(s, ["event_type"], "ts", "1 day"), "tumbling_out", "complete")
    want = E.tumbling(e, ["event_type"], "ts", "1 day")
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 3)) for r in df.collect())
    assert key(got) == key(want)


def test_late_rows_are_dropped(spark, tmp_path):
    p = tmp_path / "in"
    schema = "ts string, value double"
    for batch in ([("2024-01-01 00:00:00", 1.0)], [("2024-01-01 05:00:00", 1.0)], [("2024-01-01 06:00:00", 1.0)], [("2024-01-01 00:10:00", 9.0)], [("2024-01-01 12:00:00", 1.0)]):
        write(spark, p, batch, schema)
    files = sorted(p.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 5
    s = E.event_stream(spark, str(p), schema, files_per_trigger=1)
    got = E.run_to_end(E.tumbling(s, [], "ts", "1 hour", late="1 hour"), "late_out")
    assert {str(r.start): r.total for r in got.collect()}["2024-01-01 00:00:00"] == 1.0


def test_changed_tokens_survive_a_restart(spark, tmp_path):
    p, c = tmp_path / "in", str(tmp_path / "ck")
    schema = "kind string, token string, n long"
    out = str(tmp_path / "out")

    def run():
        s = spark.readStream.schema(schema).parquet(str(p))
        E.to_table(E.changed_tokens(s, "kind", "token", "n"), out, c).awaitTermination()

    write(spark, p, [("save", "a", 1), ("save", "a", 2), ("eval", "x", 3)], schema)
    run()
    write(spark, p, [("save", "a", 4), ("save", "b", 5)], schema)
    run()
    assert sorted((r.kind, r.token) for r in spark.read.parquet(out).collect()) == [("eval", "x"), ("save", "a"), ("save", "b")]


def left(spark, root, key="key"):
    """The outstanding indices of a stopped stream, by key, in order of issue."""
    out = {}
    for r in sorted(E.outstanding(spark, f"{root}/state").collect(), key=lambda r: r.at):
        out.setdefault(r[key], []).append(r.index_no)
    return out


def batches(root):
    import glob

    return len(glob.glob(f"{root.removeprefix('file://')}/rows/batch=*"))


EVENTS = "key string, action string, index_no long, n long"


def test_outstanding_indices(spark):
    rows = [("w", "issued", i, i) for i in range(5)] + [("w", "consumed", 0, 10), ("w", "consumed", 2, 11), ("w", "consumed", 99, 12), ("w", "consumed", 2, 13), (None, "issued", 7, 14)]
    root = E.new_root(spark)
    got = E.finished(E.consumption(E.replayed(spark.createDataFrame(rows, EVENTS), ["n"]), "key", "n"), "update", ["key"], root).collect()
    assert sorted((r.key, r.generated, r.consumed) for r in got) == [("None", 1, 0), ("w", 5, 2)]
    assert left(spark, root) == {"w": [1, 3, 4], None: [7]}


def test_reuse_is_limited(spark, tmp_path):
    p = tmp_path / "in"
    write(spark, p, [("a", i, True) for i in range(3)], "key string, n long, ok boolean")
    s = spark.readStream.schema("key string, n long, ok boolean").parquet(str(p))
    r = E.run_to_end(E.reuse_limited(s, "key", "n", "ok", 2), "reuse_out", "update").first()
    assert (r.uses, r.again) == (0, False)


def test_reuse_over_batches_is_that_of_a_loop(spark):
    import random

    r = random.Random(4)
    rows = [(k, n, r.choice([True, True, True, False, None])) for n, k in enumerate(r.choices("abc", k=120))]
    want = {}
    for k, _, ok in rows:
        uses = want.get(k, (0, False))[0]
        again = bool(ok) and uses < 2
        want[k] = (uses + 1 if again else 0, again)
    root = E.new_root(spark)
    df = spark.createDataFrame(rows, "key string, n long, ok boolean")
    got = E.finished(E.reuse_limited(E.replayed(df, ["n"], parts=6), "key", "n", "ok", 2), "update", ["key"], root).collect()
    assert {x.key: (x.uses, x.again) for x in got} == want and batches(root) == 6


def test_a_replayed_table_keeps_its_order(spark, data):
    """Files one after the other, whatever their tasks' order: each batch lies behind the one before."""
    e = spark.read.parquet(f"{data}/events.parquet").select("event_id")
    s = E.replayed(e.repartition(5), ["event_id"], parts=7)
    root = E.new_root(spark)
    E.started(s, root).awaitTermination()
    ranges = sorted(spark.read.parquet(f"{root}/rows").groupBy("batch").agg({"event_id": "max"}).collect())
    lows = sorted(spark.read.parquet(f"{root}/rows").groupBy("batch").agg({"event_id": "min"}).collect())
    assert len(ranges) == 7
    assert all(a[1] < b[1] for a, b in zip(ranges, lows[1:]))


def test_tokens_over_many_batches(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice(["x", "y", None]), n) for n in range(200)]
    want, last = [], {}
    for k, t, _ in rows:
        if k not in last or last[k] != t:
            want.append((k, t))
        last[k] = t
    for parts in (4, 9):
        root = E.new_root(spark)
        df = spark.createDataFrame(rows, "kind string, token string, n long")
        got = E.finished(E.changed_tokens(E.replayed(df, ["n"], parts=parts), "kind", "token", "n"), root=root).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and batches(root) == parts


def test_the_stateful_queries_have_several_batches(spark, data, monkeypatch):
    import __spark_entry__ as entry

    roots = []
    new = E.new_root
    monkeypatch.setattr(E, "new_root", lambda s: roots.append(new(s)) or roots[-1])
    for name in ("stream_tokens", "stream_cursor", "stream_reuse"):
        roots.clear()
        assert entry.queries()[name](spark, data).count() > 0
        assert batches(roots[0]) >= 4, name


def test_a_stream_stopped_in_the_middle_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [("w", "issued", i, 2 * i) for i in range(600)] + [("w", "consumed", i, 2 * i + 1) for i in range(0, 600, 2)]
    rows.sort(key=lambda r: r[3])
    p, root = tmp_path / "in", E.new_root(spark)

    def run():
        s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(p))
        return E.finished(E.consumption(s, "key", "n"), "update", ["key"], root).collect()

    write(spark, p, rows[:301], EVENTS)
    run()
    half = left(spark, root)["w"]
    assert half == [i for i in range(201) if i % 2 == 1 or i == 200][: len(half)] and len(half) == 101
    write(spark, p, rows[301:700], EVENTS)
    write(spark, p, rows[700:], EVENTS)
    (r,) = run()
    assert (r.generated, r.consumed) == (600, 300) and left(spark, root) == {"w": list(range(1, 600, 2))} and batches(root) == 3


def test_a_new_source_starts_with_what_was_outstanding(spark):
    first = [("w", "issued", i, i) for i in (5, 3, 9)] + [("w", "consumed", 3, 20), ("v", "issued", 1, 21), ("v", "consumed", 1, 22)]
    one, two = E.new_root(spark), E.new_root(spark)
    E.finished(E.consumption(E.replayed(spark.createDataFrame(first, EVENTS), ["n"]), "key", "n"), "update", ["key"], one)
    later = [("w", "consumed", 9, 30), ("w", "issued", 4, 31), ("v", "issued", 2, 32)]
    carried = E.carried_over(spark, f"{one}/state", "key")
    got = E.finished(E.consumption(E.replayed(spark.createDataFrame(later, EVENTS), ["n"]), "key", "n", carried), "update", ["key"], two).collect()
    assert sorted((r.key, r.generated, r.consumed) for r in got) == [("v", 2, 1), ("w", 4, 2)]
    assert left(spark, two) == {"w": [5, 4], "v": [2]}


def test_a_late_replica_holds_the_sample(spark, tmp_path):
    schema = "key string, round long, replica long, ok boolean"
    p, root = tmp_path / "in", E.new_root(spark)

    def run(*rows):
        write(spark, p, rows, schema)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(p))
        return sorted(tuple(r) for r in E.finished(E.agreed_reuse(s, "key", 2, 2), root=root).collect())

    assert run(("a", 0, 0, True), ("a", 1, 0, True), ("b", 1, 0, True), ("b", 1, 1, True)) == []
    assert run(("a", 1, 1, True), ("a", 2, 1, True), ("a", 2, 0, None), ("a", 9, 5, True)) == []  # round 0 still waits for replica 1
    done = [("a", 0, True, 1), ("a", 1, True, 2), ("a", 2, False, 0)]
    assert run(("a", 0, 1, True)) == done
    assert run(("a", 0, 1, False), ("b", 0, 0, False), ("b", 0, 1, True)) == [*done, ("b", 0, False, 0), ("b", 1, True, 1)]  # a settled round stays


def test_a_sliding_history_is_the_batch_operator_on_all_rows(spark):
    import random

    from lumenframe.operators.visibility import kept_history

    r = random.Random(3)
    rows = [(k, i // 4 * r.choice([1, 1, 2]), i) for i in range(160) for k in ("a", "b")]
    df = spark.createDataFrame(rows, "k string, chunk long, row long")
    ordered = df.orderBy("chunk")
    root = E.new_root(spark)
    got = E.finished(E.sliding_history(E.replayed(ordered, ["chunk", "row"], parts=6), "k", "chunk", "row", 2, 5), "update", ["key"], root).collect()
    want = sorted(tuple(x) for x in kept_history(df, ["k"], "chunk", 2, 5).select("k", "chunk", "row").collect())
    assert sorted(tuple(x) for x in E.held_rows(spark, f"{root}/state").collect()) == want and batches(root) == 6
    assert {x.key: x.held for x in got} == {k: sum(w[0] == k for w in want) for k in "ab"}


def test_documents_queue_over_restarts(spark, tmp_path):
    schema = "key string, n long, action string, item long, parts long"
    p, root = tmp_path / "in", E.new_root(spark)

    def run(*rows):
        write(spark, p, rows, schema)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(p))
        return sorted(tuple(r) for r in E.finished(E.queued_documents(s, "key", "n"), root=root).collect())

    assert run(("a", 1, "next", None, None), ("a", 2, "item", 10, 3), ("a", 3, "next", None, None)) == [("a", 0, 10, 0), ("a", 1, 10, 1)]
    assert run(("a", 4, "next", None, None), ("a", 5, "next", None, None), ("a", 6, "item", 11, 0), ("a", 7, "item", 12, 1)) == [("a", 0, 10, 0), ("a", 1, 10, 1), ("a", 2, 10, 2), ("a", 3, 12, 0)]


def test_many_keys_share_groups_of_the_state_store(spark):
    """A group of the stream is a bucket of keys, never a key; keys beside a null stay whole numbers."""
    from lumenframe.streaming import state

    who = [None, *range((1 << 60) + 1, (1 << 60) + 3000)]
    rows = [(k, n, a, n, 1) for n, a in enumerate(["next", "item", "item", "next"]) for k in who]
    df = spark.createDataFrame(rows, "who long, n long, action string, item long, parts long")
    root = E.new_root(spark)
    got = E.finished(E.queued_documents(E.replayed(df, ["n"], parts=3), "who", "n"), root=root).collect()
    assert sorted(map(tuple, got)) == sorted((str(k), i, i + 1, 0) for k in who for i in range(2))
    groups = spark.read.format("statestore").option("path", f"{root}/state").option("stateVarName", "counts").load().count()
    assert groups <= state.BUCKETS < len(who)

    events = spark.createDataFrame([(k, a, 7, n) for n, a in enumerate(["issued", "consumed", "issued"]) for k in who], "who long, action string, index_no long, n long")
    root = E.new_root(spark)
    E.finished(E.consumption(E.replayed(events, ["n"], parts=3), "who", "n"), "update", ["key"], root)
    assert left(spark, root, "who") == {k: [7] for k in who}


def test_control_files(spark, tmp_path):
    from lumenframe.sources.control import control_stream

    folder, root = tmp_path / "control", E.new_root(spark)
    (folder / "groups" / "g").mkdir(parents=True)
    (folder / "groups" / "g" / "vis_request").write_text("other group")
    put = lambda name, text: (folder / name).write_text(text)

    def run():
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/rows/batch={n}")
        q = control_stream(spark, str(folder), kinds="save,vis").writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/state").start()
        try:
            q.processAllAvailable()
            yield q
        finally:
            q.stop()

    seen = lambda: sorted(tuple(r) for r in spark.read.schema("kind string, token string, batch long").parquet(f"{root}/rows").select("kind", "token").collect())
    put("save_request", "old\n")
    for q in run():
        put("save_request", " one \n"), put("vis_request", ""), put("stop_request", "x"), put("save_done", "y")
        q.processAllAvailable()
        assert seen() == [("save", "one")]
        put("save_request", "one")
        q.processAllAvailable()
    put("vis_request", "v1")
    for q in run():  # a restart takes what is new, and repeats nothing
        assert seen() == [("save", "one"), ("vis", "v1")]
        (folder / "save_request").unlink()
        q.processAllAvailable()
        put("save_request", "one")
        q.processAllAvailable()
        assert seen() == [("save", "one"), ("vis", "v1")]


def test_a_changed_source_is_refused(spark, tmp_path):
    import pytest

    path = f"file://{tmp_path}/cursor"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    for _ in range(2):
        assert E.guarded(df, ["k", "v"], path).count() == 2
    for other in (df.where("k = 1"), df.withColumn("k", 3 - df.k), df.where("k = 9")):
        with pytest.raises(ValueError, match="has changed"):
            E.guarded(other, ["k", "v"], path)
