import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from duck import same
from lumenframe.llm import fill_middle as M
from lumenframe.llm import queries as Q

PATTERNS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+", "char": r"(?s)."}


def brute(doc_id, text, unit="line", rate=100, flipped=50, seed="7"):
    """(doc_id, n, form, prefix_chars, middle_chars, output) of one text, from the rule."""
    text = text or ""
    units = re.findall(PATTERNS[unit], text)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in M.MARKS) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < flipped else (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("unit", sorted(M.UNITS))
def test_random_texts(spark, unit):
    r = random.Random(5)
    parts = ["a", "bc", "\n", "\n\n", " ", "\t", "é", "日本", "😀", "<", ">", "S>", "<S", "<P>", "\r\n", "\x00", "."]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(-50, 1200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = M.fill_in_middle(df, unit=unit, rate=80, flipped=30)
    assert rows(got) == sorted((brute(i, t, unit, 80, 30) for i, t in docs), key=repr)
    assert {r[2] for r in rows(got)} == {"plain", "psm", "spm"}
    back = got.withColumn("t", M.restored(F.col("output"), F.col("form")))
    assert sorted((x.doc_id, x.t) for x in back.collect()) == sorted(docs)


def test_odd_rows(odd_docs, no_docs, plain):
    assert rows(M.fill_in_middle(odd_docs)) == sorted((brute(i, t) for i, t in plain), key=repr)
    assert M.fill_in_middle(no_docs).count() == 0


def test_a_chunk_border_changes_nothing(spark, monkeypatch):
    import lumenframe.llm.textbuf as T

    docs = [(i, f"line {i}\n" * (i % 7) + "end") for i in range(200)] + [(999, "x\n" * 700_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert rows(M.fill_in_middle(df)) == sorted((brute(i, t) for i, t in docs), key=repr)
    assert T.CHUNK_BYTES < 1_400_000


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("", "b", "c"), ("ab", "ba", "c")])
def test_marks_that_cannot_be_found_again_are_refused(spark, marks):
    with pytest.raises(ValueError, match="marks"):
        M.fill_in_middle(spark.createDataFrame([(1, "x")], "doc_id long, text string"), marks=marks)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in Q.table(spark, path, "documents").select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(((*(b := brute(i, t))[:5], sha(b[5]), sha(t or "")) for i, t in docs), key=repr)
    assert rows(Q.op13_fill_middle(spark, path)) == want


def test_query_equals_its_sql(spark, data):
    same(Q.op13_fill_middle(spark, data), Q.ORACLES["op13_fill_middle"], data)
