import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    import os

    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def scores(df, labels, label):
    r = df.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("y")).toPandas()
    return r.score.to_numpy(), r.predicted.to_numpy(), r.y.to_numpy()


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


def test_quality_on_held_out_rows(tables):
    s, p, y = scores(quality.classify(*tables), tables[1], "quality")
    assert auc(s, y) > 0.9 and (p == (s >= 0.7)).all() and p[y == 1].mean() > 0.9


def test_toxicity_on_held_out_rows(tables):
    s, p, y = scores(toxicity.classify(*tables), tables[1], "toxic")
    assert auc(s, y) > 0.75 and (p == (s >= 0.7)).all() and p[y == 0].mean() < 0.05


@pytest.mark.parametrize("op, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, odd_docs, no_docs, plain, op, label):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (9, 1, None), (None, 0, 1), (77, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = op.classify(odd_docs, labels).collect()
    assert len(got) == len(plain) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert op.classify(no_docs, labels).count() == 0
    assert op.classify(odd_docs, labels.where("1 = 0")).count() == len(plain)


def test_scores_repeat(tables):
    docs, labels = tables
    a, b = (sorted(map(tuple, quality.classify(d, labels).select("doc_id", "score").collect())) for d in (docs, docs.repartition(7)))
    assert np.allclose([x[1] for x in a], [x[1] for x in b], atol=0.02)


def test_held_out_labels_are_not_learned(tables):
    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_word_vectors_are_neighbours_sums():
    buf = np.frombuffer(b"aa bb", np.uint8)
    tok, doc = quality.tokens(buf, np.array([0, 5]))
    assert len(tok) == 4 and tok[1] == tok[3] and (doc == 0).all()  # word, shape, word, shape


def test_few_labels_are_learned_from():
    x = np.array([[-2.0], [-1.5], [-1.8], [-1.1], [1.2], [1.9], [1.4], [2.0], [1.6]])
    y = (x[:, 0] > 0).astype(float)
    net = quality.Network(x, y)
    assert net.constant is None and ((net.probability(x) > 0.5) == (y == 1)).all()
    assert quality.Network(x[:2], np.array([0.0, 1.0])).constant is None
    assert quality.Network(x[:4], y[:4]).probability(x).tolist() == [0.0] * 9 and quality.Network(x[:0], y[:0]).constant == 0.5


def test_the_sample_is_bounded_where_ids_repeat(spark):
    from lumenframe.llm import samples

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(5000)] + [(2, "one")], "doc_id long, text string")
    got = samples.texts_of(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def plain_tokens(text):
    """Tokens of a text, from a regular expression: (bytes, shape or None)."""
    for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x80-\xff]+", text.encode()):
        w = m.group()
        if re.match(rb"[0-9A-Za-z\x80-\xff]", w):
            upper, digit = len(re.findall(rb"[A-Z]", w)), len(re.findall(rb"[0-9]", w))
            yield w.lower(), (3 if digit else min(upper, 2)) * 3 + (len(w) >= 4) + (len(w) >= 12)
        else:
            yield w, None


def test_quality_features_equal_brute_force(spark, data):
    """Word vectors and pooled features of the whole table, token by token."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [r.text or "" for r in docs.select("text").collect()]
    place, sign = quality.index_vectors()

    def bucket(w):
        a = np.frombuffer(w, np.uint8)
        return int(quality.span_hashes(a, np.array([0]), np.array([len(a)]))[0] % np.uint64(quality.BUCKETS - 64)) + 64

    known, lists = {}, []
    for t in texts:
        own = []
        for w, shape in plain_tokens(t):
            if w not in known:
                known[w] = bucket(w)
            own += [known[w]] if shape is None else [known[w], shape]
        lists.append(own)
    table, count = np.zeros((quality.BUCKETS, quality.DIM)), np.zeros(quality.BUCKETS)
    for own in lists:
        for i, x in enumerate(own):
            count[x] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(own):
                    np.add.at(table[x], place[own[j]], sign[own[j]])
    v = table / np.maximum(count, 1)[:, None] - table.sum(axis=0) / count.sum()
    v[count == 0] = 0
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    vectors = quality.word_vectors(docs)
    assert np.allclose(vectors, v, atol=1e-4)
    want = np.array([np.concatenate([v[own].sum(axis=0) / (len(own) + 8), v[own].std(axis=0)]) if own else np.zeros(96) for own in lists])
    data_, off = "".join(texts).encode(), np.cumsum([0] + [len(t.encode()) for t in texts])
    assert np.allclose(quality.pooled(vectors, np.frombuffer(data_, np.uint8), off), want, atol=2e-3)


def test_positives_hidden_among_the_unlabelled_are_found():
    r = np.random.default_rng(0)
    make = lambda at, n: r.normal(at, 0.3, (n, 3)).astype(np.float32)
    known, hidden, negative = make(1.0, 200), make(1.0, 40), make(0.0, 360)
    c = toxicity.Classifier(known, np.concatenate([hidden, negative]), 0.1)
    assert c.probability(hidden).mean() > 0.9 and c.probability(negative).mean() < 0.1


def parts(text):
    """Words and their beginnings and ends: (kind, bytes)."""
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()):
        yield 1, w
        for k, n in enumerate((4, 5, 6, 7, 8)):
            if len(w) > n:
                yield 2 + 2 * k, w[:n]
                yield 3 + 2 * k, w[-n:]


def test_toxicity_counts_and_features_equal_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(toxicity, "KEPT", 40)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    known = {}

    def bucket(kind, w):
        if (kind, w) not in known:  # the polynomial hash of the operator, with integers
            h, p = 0, 1
            for c in w:
                h, p = (h + int(toxicity.BYTE_VALUES[c]) * p) % 2**64, p * 0x9E3779B97F4A7C15 % 2**64
            known[kind, w] = int(toxicity.mix(np.array([(h + kind) % 2**64], np.uint64))[0] % np.uint64(toxicity.BUCKETS))
        return known[kind, w]

    lists = {i: [bucket(k, w) for k, w in parts(t)] for i, t in texts.items()}
    counts = {r.bucket: r.n for r in toxicity.document_counts(docs).collect()}
    want = {}
    for own in lists.values():
        for b in set(own):
            want[b] = want.get(b, 0) + 1
    assert counts == want
    some = sorted(texts)[::5]
    kept = toxicity.choose(docs.where(F.col("doc_id").isin(some)), docs, len(some), len(texts))
    z = {}
    for b, n in want.items():
        k = sum(b in set(lists[i]) for i in some) if n >= 3 else 0
        x, y, both = k / len(some), n / len(texts), (k + n) / (len(some) + len(texts))
        if k >= 3 and x > 1.5 * y:
            z[b] = (x - y) / (both * (1 - both) * (1 / len(some) + 1 / len(texts)) + 1e-12) ** 0.5
    assert sorted(kept.tolist()) == sorted(sorted(z, key=lambda b: (-round(z[b], 9), b))[:40])
    ids = list(texts)[:40]
    raw, off = "".join(texts[i] for i in ids).encode(), np.cumsum([0] + [len(texts[i].encode()) for i in ids])
    got = toxicity.features(kept, np.frombuffer(raw, np.uint8), off)
    for row, i in zip(got, ids):
        n = [lists[i].count(b) for b in kept.tolist()]
        words = sum(k == 1 for k, _ in parts(texts[i]))
        assert np.allclose(row, np.concatenate([np.log1p(n), np.array(n) / (words + 20) * 20, [np.log1p(words) / 4]]), atol=1e-5)


def test_scores_are_those_of_the_fitted_model(spark, data):
    """The whole query, from its own features and weights, row by row."""
    import zlib

    from lumenframe.llm import queries, samples

    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    kept, model = toxicity.train(docs.where(samples.fold(3) != 1), labels.where(samples.fold(3) != 1))
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, data).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        x = toxicity.features(kept, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        p = 1 / (1 + np.exp(-(x @ model.w + model.b))) if model.w is not None else 0.0
        assert abs(got[r.doc_id].score - p) < 1e-5 and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert len(got) == docs.count()


def test_the_network_goes_down_its_gradient():
    """Gradients by finite differences of the loss, written out."""
    r = np.random.default_rng(0)
    z, y = r.normal(size=(40, 6)), (r.random(40) < 0.4).astype(float)
    net = quality.Network(z, y)
    p = [r.normal(size=a.shape) for a in net.p]

    def loss(q):
        logit = np.tanh(z @ q[0] + q[1]) @ q[2] + q[3]
        return np.mean(np.log1p(np.exp(-np.where(y == 1, logit, -logit)))) + 5e-5 * ((q[0] ** 2).sum() + (q[2] ** 2).sum())

    net.p = p
    for k, g in enumerate(net._gradient(z, y)):
        for at in list(np.ndindex(*p[k].shape))[:9]:
            up, down = ([a.copy() for a in p] for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - g[at]) < 1e-6


def test_the_temperature_calibrates_the_rows_kept_aside():
    """Labels drawn with probabilities that the features give: no other temperature of a fine grid has a lower loss aside."""
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 4))
    y = (r.random(1500) < 1 / (1 + np.exp(-0.7 * x[:, 0]))).astype(float)
    net = quality.Network(x, y)
    aside = np.random.default_rng(3).permutation(1500)[:300]
    logit = net._logit((x[aside] - net.mean) / net.scale)

    def loss(t):
        p = 1 / (1 + np.exp(-logit / t))
        return -np.mean(np.where(y[aside] == 1, np.log(p), np.log(1 - p)))

    assert net.temperature > 1  # the network is too sure of itself on so few rows
    assert loss(net.temperature) <= min(loss(t) for t in np.linspace(0.25, 10, 300)) + 1e-4
    assert abs(net.probability(x[aside]).mean() - y[aside].mean()) < 0.06


def nn_pu_fit(positive, unlabelled, prior, steps):
    """The non-negative PU risk of a linear model, written out: sigmoid losses, and a step up where the negative part is below 0."""
    w = np.concatenate([np.full(positive.shape[1], 0.05), [-1.0]])
    ones = lambda x: np.concatenate([x, np.ones((len(x), 1))], axis=1)
    xp, xu, m, v = ones(positive), ones(unlabelled), np.zeros(len(w)), np.zeros(len(w))
    risk = {
        "called positive": lambda x, w: np.mean(1 / (1 + np.exp(-x @ w))),  # the loss of a row that is taken for negative
        "called negative": lambda x, w: np.mean(1 / (1 + np.exp(x @ w))),
    }

    def slope(f):
        out = np.zeros(len(w))
        for k in range(len(w)):
            a, b = w.copy(), w.copy()
            a[k] += 1e-6
            b[k] -= 1e-6
            out[k] = (f(a) - f(b)) / 2e-6
        return out

    for t in range(1, steps + 1):
        negative = lambda w: risk["called positive"](xu, w) - prior * risk["called positive"](xp, w)
        g = slope(lambda w: prior * risk["called negative"](xp, w) + negative(w)) if negative(w) >= 0 else slope(lambda w: -negative(w))
        g += 1e-5 * np.concatenate([w[:-1], [0]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def test_the_pu_fit_is_the_risk_written_out():
    r = np.random.default_rng(7)
    hidden = r.normal(1.5, 1, (60, 3))
    unlabelled = np.concatenate([hidden[:20], r.normal(-1, 1, (100, 3))])
    positive = hidden[20:]
    for steps, prior in ((60, 0.15), (120, 0.6)):  # with the second prior the negative part falls below 0 on the way
        model = toxicity.Classifier(positive.astype(np.float32), unlabelled.astype(np.float32), prior, steps)
        want = nn_pu_fit(positive, unlabelled, prior, steps)
        assert np.allclose([*model.w, model.b], want, atol=2e-2), (model.w, model.b, want)
