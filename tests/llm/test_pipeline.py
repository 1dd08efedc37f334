"""The pipeline against a plain version in Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lumenframe.llm import language_id
from test_decontaminate import brute as contaminated
from test_jaccard_join import shingles


def plain(docs, items, languages, library):
    """Rows (doc_id, n_tokens, ids digest) that should come out; ``languages`` has what the language stage says."""
    rows = [(i, t) for i, t in docs if languages[i] != "und"]
    best = {}
    for i, t in rows:
        best[t] = max(i, best.get(t, i))
    rows = sorted((i, t) for t, i in best.items())
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    rows = [r for k, r in enumerate(rows) if root(k) == k]
    bad = {r[0] for r in contaminated(rows, items) if r[4]}
    out = []
    for i, t in rows:
        if i not in bad:
            ids = library.encode(t, add_eos=True)
            out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    return sorted(out)


def test_pipeline(spark, data):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.tokenizer_path())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    languages = {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()}
    assert all(v != "und" or not re.search(r"[^\W\d_]", t) for (i, t), v in zip([(r.doc_id, r.text) for r in docs.collect()], [languages[r.doc_id] for r in docs.collect()]))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], items, languages, library)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in P.run(spark, data).collect())
    assert got == want and 0 < len(got) < docs.count()


def test_stages_return_the_columns_of_documents(spark, odd_docs, no_docs, data):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, odd_docs, data).columns == odd_docs.columns
        assert stage(spark, no_docs, data).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_text(spark, data):
    """Every stage but the last, on rows of one id: each text has its own fate, and its own columns."""
    good = [f"some words of text number {k} that nothing else is like, {k * 7} times over" for k in range(6)]
    bench = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    rows = [(1, t, f"v{k}") for k, t in enumerate(good)] + [(1, "12 34", "no letter"), (1, bench, "contaminated"), (1, good[0], "copy"), (None, good[1] + "!", "near copy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _class_id string").withColumns({"lang": F.lit("en"), "_kept_id": F.col("_class_id")})
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, data)
    kept = docs.collect()
    assert sorted(r.text for r in kept) == sorted(good) and all(r._kept_id == r._class_id for r in kept)
