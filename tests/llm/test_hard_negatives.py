import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duck import same
from lumenframe.llm import hard_negatives as H
from lumenframe.llm import queries as Q

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    """All pairs, in Python integers; rows of (id, label, vector)."""
    sound = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) and abs(256 * x) <= H.MOST for x in v)]
    out = set()
    for i, y, v in sound:
        if not anchor(i):
            continue
        scores = [(-sum(p * q for p, q in zip(v, w)), j, z) for j, z, w in sound if j != i]
        for s, j, _ in sorted(x for x in scores if x[2] == y)[:positives]:
            fit = sorted((t, k) for t, k, z in scores if z != y and low * -s <= 100 * -t <= high * -s)[:negatives]
            out |= {(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(fit)}
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "q", "n", "block", "cell", "anchor", "_id", "_part", "score")})


def mined(df, every=50, **k):
    return sorted(tuple(r[c] for c in COLUMNS) for r in H.hard_negatives(df, F.col("vec_id") % every == 0, **k).collect())


def clustered(n, dims=6, groups=12, labels=4, seed=0):
    r = np.random.default_rng(seed)
    c = r.normal(size=(groups, dims))
    c /= np.sqrt((c**2).sum(1, keepdims=True))
    g = r.integers(0, groups, n)
    return [(int(i), int(y), [float(x) for x in v]) for i, y, v in zip(r.permutation(n), r.integers(0, labels, n), c[g] + 0.03 * r.normal(size=(n, dims)), strict=True)]


def test_many_small_blocks_equal_all_pairs(spark, monkeypatch):
    for name, size in (("BLOCK_BYTES", 24 * 30), ("ANCHOR_BYTES", 24 * 16), ("CHUNK", 2), ("FAN", 4), ("LEAF", 4), ("ANCHOR_LEAF", 2), ("DEPTH", 4)):
        monkeypatch.setattr(H, name, size)
    rows = clustered(400)
    assert mined(frame(spark, rows), 10, positives=2, negatives=7, low=10, high=120) == brute(rows, lambda i: i % 10 == 0, 2, 7, 10, 120)


def test_a_hot_vector_and_ties(spark, monkeypatch):
    for name, size in (("BLOCK_BYTES", 16 * 50), ("ANCHOR_BYTES", 16 * 20), ("LEAF", 8)):
        monkeypatch.setattr(H, name, size)
    r = np.random.default_rng(1)
    rows = [(i, int(i % 3 == 0), [0.5, 0.25, 0.0, 1.0] if i % 2 else [float(x) for x in r.integers(-2, 3, 4) / 4]) for i in range(600)]
    assert mined(frame(spark, rows), 7, low=0, high=100) == brute(rows, lambda i: i % 7 == 0, low=0, high=100)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (50, 1, [1.0, 0.5, 0.25]), (100, None, [1.0]), (150, 2, None), (200, 2, []), (250, 1, [nan, 1.0]), (300, 1, [inf, 1.0]), (350, 1, [1.0, None]), (None, 1, [1.0, 0.5]), (400, 1, [1e9, 0.0]),
        (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (1, 2, [0.75, 0.25]), (2, 2, [0.75, 0.25]), (3, 2, [-1.0, 0.0]), (0, 1, [1.0, 0.5]), (4, 3, [0.5, 0.5]), (5, 1, [-1.0, -0.001]), (6, 2, [0.0, 0.0]),
    ]
    want = [x for x in brute(rows, lambda i: i % 50 == 0)]
    got = mined(frame(spark, rows))
    assert set(got) == set(want) and len(got) >= len(want) > 0
    assert mined(frame(spark, rows[2:5])) == [] and mined(frame(spark, rows).where("1 = 0")) == []
    assert mined(frame(spark, [(1, 1, [1.0])])) == []


def test_pruning_scores_few_pairs_of_clustered_rows():
    rows = clustered(4000, groups=40, labels=2, seed=3)
    v = np.floor(256 * np.array([x[2] for x in rows]))
    ids, labels = np.array([x[0] for x in rows]), np.array([x[1] for x in rows])
    s = H.Search(H._Tree(v[:200], ids[:200], labels[:200], 2), np.arange(200), np.arange(200), np.full(200, H._NONE + 1), np.full(200, -H._NONE), 5, True)
    s.run(H._Tree(v, ids, labels, 16))
    got = {(q, i, x) for q, i, x in zip(*(s.found().column(c).to_pylist() for c in ("query", "id", "score")), strict=True)}
    exact = v[:200].astype(int) @ v.T.astype(int)
    for q in range(200):
        own = sorted((-exact[q, j], ids[j]) for j in range(4000) if labels[j] == labels[q] and ids[j] != ids[q])[:5]
        assert {(q, i, -x) for x, i in own} <= got
    assert s.scored < 0.25 * exact.size


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/sf{sf}"
    same(Q.op12_hard_negatives(spark, path), Q.ORACLES["op12_hard_negatives"], path)
