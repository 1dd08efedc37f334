import hashlib
import uuid
from collections import defaultdict

from pyspark.sql import functions as F

from lumenframe.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [k for k in groups[t or ""] if k is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(odd_docs, plain):
    got = sorted((tuple(r) for r in X.exact_dedup(odd_docs, buckets=4).collect()), key=repr)
    assert got == brute(plain)


def test_no_rows(no_docs):
    assert X.exact_dedup(no_docs, buckets=2).count() == 0


def test_index_persists_between_loads(spark):
    name = f"digests_{uuid.uuid4().hex}"
    schema = "doc_id long, text string"
    index = X.DigestIndex(spark, name, 4)
    first = index.ingest(spark.createDataFrame([(1, "a"), (5, "a"), (2, "b")], schema))
    assert {r.doc_id: r.kept for r in first.collect()} == {1: False, 5: True, 2: True}
    second = X.DigestIndex(spark, name, 4).ingest(spark.createDataFrame([(9, "a"), (8, "c")], schema))
    assert {r.doc_id: (r.keep_id, r.kept) for r in second.collect()} == {9: (5, False), 8: (8, True)}
    assert index.read().count() == 3


def test_anti_join_is_sort_merge_and_spares_the_index_a_shuffle(spark):
    name = f"digests_{uuid.uuid4().hex}"
    index = X.DigestIndex(spark, name, 4)
    index.ingest(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count()
    new = X.digests(spark.createDataFrame([(2, "b")], "doc_id long, text string")).repartition(4, "text_sha256")
    plan = new.join(index.read().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(text_sha256") == 1


def test_columns_come_back_once(odd_docs):
    kept = X.deduplicated(odd_docs, buckets=2)
    assert kept.columns == odd_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts))


def test_a_repeated_load_has_the_same_verdicts(spark):
    index = X.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", 4)
    docs = spark.createDataFrame([(1, "a"), (5, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    index.ingest(spark.createDataFrame([(0, "b")], "doc_id long, text string"), load_id="before").collect()
    first = sorted(index.ingest(docs, load_id="mine").collect())
    assert [r.kept for r in first] == [False, False, True, True]
    assert sorted(index.ingest(docs, load_id="mine").collect()) == first and index.read().count() == 3
    assert not any(r.kept for r in index.ingest(docs, load_id="other").collect())


def test_rows_of_hot_and_other_digests(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT_SHARE", 3)
    rows = [(i, "hot") for i in range(40)] + [(100 + i, f"text {i // 2}") for i in range(30)]
    got = sorted((tuple(r) for r in X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), buckets=4).collect()), key=repr)
    assert got == brute(rows)


def test_nothing_is_left_of_a_single_call(spark, odd_docs):
    before = {t.name for t in spark.catalog.listTables()}
    X.exact_dedup(odd_docs, buckets=2).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "b", "z")], "doc_id long, text string, _kept_id string")
    docs = docs.withColumns({c: F.col("_kept_id") for c in ("_kept_sha", "__kept_id", "group_size", "fresh", "load_id")})
    kept = X.deduplicated(docs, buckets=2)
    assert kept.columns == docs.columns and sorted((r.text, r._kept_id, r._kept_sha) for r in kept.collect()) == [("a", "y", "y"), ("b", "z", "z")]


def test_a_digest_that_two_loads_appended_has_one_owner(spark):
    """Two loads that read the index before either appends; rows of later loads come out once each."""
    index = X.DigestIndex(spark, f"digests_{uuid.uuid4().hex}", 4)
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    (sha,) = {r.text_sha256 for r in X.digests(docs).collect()}
    for load, keep in (("m", 7), ("k", 9)):
        index._append(spark.createDataFrame([(sha, keep, load)], "text_sha256 string, keep_id long, load_id string"))
    got = sorted(index.ingest(docs, load_id="later").collect())
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got] == [(1, 9, 2, False), (2, 9, 2, False)]
    again = index.ingest(spark.createDataFrame([(9, "a")], "doc_id long, text string"), load_id="k").collect()
    assert [(r.doc_id, r.keep_id, r.kept) for r in again] == [(9, 9, True)]
