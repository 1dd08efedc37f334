import random
import re

import numpy as np
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate as D
from lumenframe.llm import queries


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())


def brute(rows, items):
    pats = {}
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            pats.setdefault(tuple(w[k : k + n]), set()).add(str(i) if i is not None else "null")
    sizes = {len(p) for p in pats}
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in pats:
                    hit |= set(range(k, k + n))
                    found |= pats[p]
        out.append((d, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=repr)


ITEMS = [(10, "seven wizards boil strange purple potions under an old stone bridge near the river"), (9, "SHARE nothing"), (8, None), (7, "!!"), (6, "one"), (None, "words stand here"), (5, "share NOTHING")]


def test_odd_rows(spark, odd_docs, no_docs, plain, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(plain, ITEMS)
    assert got(D.contamination(odd_docs, bench)) == want
    with monkeypatch.context() as m:  # full tables let every place through
        m.setattr(D, "MIN_BITS", 1), m.setattr(D, "MAX_BITS", 2)
        assert got(D.contamination(odd_docs, bench)) == want
    assert D.contamination(no_docs, bench).count() == 0
    clean = D.contamination(odd_docs, bench.where("1 = 0")).collect()
    assert len(clean) == len(plain) and not any(r.contaminated for r in clean)


def test_random_texts(spark):
    r = random.Random(2)
    vocab = ["a", "b", "c", "d"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 12, 13, 14, 20])))) for i in range(6)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 5, 30, 700]))) + " " + r.choice(items)[1]) for i in range(30)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.contamination(df, bench)) == brute(rows, items)


def test_whole_table_equals_sql(spark, data):
    from duck import same

    same(queries.op8_decontamination(spark, data), queries.ORACLES["op8_decontamination"], data)


def test_shift_table_skips():
    t = D.WuManber(3, 12).fill(*D.table_rows(np.array([[11, 22, 33]], np.uint64), 12))
    assert t.shift.max() == 2 and (t.shift == 0).sum() == 1 and t.some.sum() == 1
    h = np.array([5, 11, 22, 33, 7, 11, 22], np.uint64)
    assert t.search(h, np.array([0, 7]))[0].tolist() == [1] and not len(t.search(h, np.array([0, 3, 7]))[0])


def test_stage_drops_contaminated(spark, odd_docs):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    kept = D.clean_documents(odd_docs, bench)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == odd_docs.columns and not ids & {1, 2, 6} and {3, 4, 9, 10} <= ids


def test_stage_judges_rows_not_ids(spark):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    rows = [(1, ITEMS[0][1], "a"), (1, "clean words under the same id", "b"), (None, ITEMS[0][1], "c"), (None, "clean", "d"), (2, None, "e"), (2, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad_id string").withColumns({c: F.col("_bad_id") for c in ("_bad_key", "__bad_id", "row", "found", "text_key", "contaminated")})
    kept = D.clean_documents(docs, bench)
    assert kept.columns == docs.columns and sorted(r._bad_id for r in kept.collect()) == ["b", "d", "e", "f"]


def test_long_texts_and_many_occurrences(spark):
    """A passage that occurs thousands of times in one text, and a window that many items share."""
    passage = ITEMS[0][1]
    rows = [(1, f"{passage} and more " * 3000), (2, "filler " * 100_000 + passage), (3, passage.upper())]
    items = [(i, passage) for i in range(50)] + [(99, "and more seven")]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.contamination(df, bench)) == brute(rows, items)
