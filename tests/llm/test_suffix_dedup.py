import hashlib
import random

import numpy as np
import pytest

from lumenframe.llm import queries
from lumenframe.llm import suffix_dedup as S


def brute(rows):
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda x: (x[0], x[1]))
    seen, result = set(), {}
    for there, i, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = True
            else:
                seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        result[(i if there else None, t)] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *result[(i, t or "")]) for i, t in rows), key=repr)


def got(df, **how):
    return sorted((tuple(r) for r in S.suffix_dedup(df, **how).collect()), key=repr)


def test_odd_rows(odd_docs, no_docs, plain):
    # the two texts of id 9 share nothing, so their order does not matter
    assert got(odd_docs) == brute(plain)
    assert S.suffix_dedup(no_docs).count() == 0


@pytest.mark.parametrize("hot", [S.HOT_BYTES, 400])
def test_shared_passages_and_hot_keys(spark, hot):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(40):
        a, b = r.randrange(0, len(passage) - 150), r.randrange(101, 160)
        text = " ".join(word() for _ in range(20)) + passage[a : a + b] + " ".join(word() for _ in range(20))
        rows.append((i, text if i % 9 else text + text))
    rows.append((50, "ab" * 200))
    rows.append((51, "xy" + "ab" * 100))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), hot_bytes=hot, text_bytes=200) == brute(rows)


@pytest.mark.parametrize("hot", [S.HOT_BYTES, 400])
def test_repeated_row_of_the_first_owner(spark, hot):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8)))
    words = lambda n: " ".join(word() for _ in range(n))
    passage = words(60)[:240]
    first = words(30) + passage + words(30)
    rows = [(1, first), (1, first), (2, words(30) + passage[20:200] + words(30)), (3, words(40))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    result = got(df, hot_bytes=hot)
    assert result == brute(rows)
    assert [x[2] for x in result] == [0, 0, 180, 0]


def test_whole_table_equals_sql(spark, data):
    from duck import same

    same(queries.op7_suffix_dedup(spark, data), queries.ORACLES["op7_suffix_dedup"], data)


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 80))
    s = r.integers(1, int(r.integers(2, 6)), n)
    if seed % 4 == 0:
        s = np.resize(s[:3], n)
    assert S.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_equal_windows_have_equal_anchors():
    r = random.Random(1)
    shared = bytes(r.choice(b"abcd ") for _ in range(100))
    texts = [bytes(r.choice(b"abcd ") for _ in range(r.randint(0, 200))) + shared + bytes(r.choice(b"abcd ") for _ in range(r.randint(0, 200))) for _ in range(30)]
    buf, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    key, doc, start, n = S.anchor_runs(buf, off)
    of = []
    for d, t in enumerate(texts):
        p = t.index(shared)
        own = (doc == d) & (start <= p) & (p < start + n)
        assert own.sum() == 1
        of.append(int(key[own][0]))
    assert len(set(of)) == 1
    assert n.sum() == sum(max(0, len(t) - 99) for t in texts)


@pytest.mark.parametrize("hot", [S.HOT_BYTES, 400])
def test_strings_with_equal_polynomial_hashes(spark, hot):
    from test_sentencepiece import thue_morse

    a, b = thue_morse(2048)
    rows = [(1, a), (2, b), (3, a[:1500]), (4, "x" * 150)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), hot_bytes=hot) == brute(rows)
