"""Toxicity: non-negative positive-unlabelled learning.

Positives are documents with a confirmed toxic label; the unlabelled set is the text of
labelled rows, whatever their label, which is not looked at. With class prior p and sigmoid
loss, the risk of a classifier g is p * R+(positives) + max(0, R-(unlabelled) - p *
R-(positives)); where the second part turns negative, a step goes against it, so that the
classifier cannot gain by calling the positives among the unlabelled negative. The prior is
the share of toxic rows among the labelled ones that may be learned from, which are the
rows that the unlabelled set is taken from; it holds for the corpus as far as the labelled
rows are a fair sample of it.

Features: words (lower-cased) and their beginnings and ends of ``PARTS`` bytes, hashed to
``BUCKETS``; of those, the ``KEPT`` whose share among the positives stands out most against
their share among all documents that may be learned from, which each task of a scan
counts with one table. A document has, for each kept bucket, the logarithm of one plus
its count and its rate per word, and the logarithm of its number of words. The classifier
is fitted, and its buckets chosen, with at most ``MAX_POSITIVE`` of the labelled positives
and ``MAX_UNLABELLED`` unlabelled rows.

Defined results: null counts as empty; a text without a word gets the score of an empty
vector; labels that are null are ignored; without a positive the score is 0; rows that
repeat an id are scored each on its own, and count as one where they are learned from;
columns besides those named are ignored. Scores repeat to about 1e-8 between partitionings,
as sums of floats do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples
from .quality import SCHEMA, THRESHOLD
from .tables import saved
from .textbuf import BYTE_VALUES, HASH_BLOCK, WORDS, batch, chunks, mix, powers, spans_of

PARTS = (4, 5, 6, 7, 8)
BUCKETS, KEPT, STEPS = 1 << 20, 300, 500
MAX_POSITIVE, MAX_UNLABELLED = 6_000, 12_000
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def word_features(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of words and then of each kind of word part, for one block of the chunk after another."""
    norm = WORDS[buf]
    every, stop = spans_of(norm != 0, off)
    docs = np.searchsorted(off, every, "right") - 1
    i = 0
    while i < len(every):  # so many bytes of words at a time
        lo = int(every[i])
        j = max(i + 1, int(np.searchsorted(every, lo + HASH_BLOCK)))
        s, e, doc = every[i:j] - lo, stop[i:j] - lo, docs[i:j]
        part = BYTE_VALUES[norm[lo : lo + int(e[-1])]]
        p, inv = powers(len(part) + 1)
        acc = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * p[:-1], out=acc[1:])

        def hashed(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
            return (mix((acc[b] - acc[a]) * inv[a] + np.uint64(kind)) % np.uint64(BUCKETS)).astype(np.int64)  # noqa: B023

        yield hashed(s, e, 1), doc
        size = e - s
        for k, length in enumerate(PARTS):
            own = size > length
            a, b, d = s[own], e[own], doc[own]
            yield hashed(a, a + length, 2 + 2 * k), d
            yield hashed(b - length, b, 3 + 2 * k), d
        i = j


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the buckets that a task meets, the number of its documents that have them."""
    total = np.zeros(BUCKETS, np.int64)
    for _, buf, off in chunks(batches):
        for b, d in _distinct(buf, off):
            total += np.bincount(b, minlength=BUCKETS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])


def _distinct(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (bucket, document) of a chunk."""
    keys = [d * BUCKETS + b for b, d in word_features(buf, off)]
    if keys:
        key = np.unique(np.concatenate(keys))
        yield key % BUCKETS, key // BUCKETS


def document_counts(texts: DataFrame) -> DataFrame:
    """(bucket, n): in how many of the rows' texts a bucket occurs."""
    return texts.select("text").mapInArrow(_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def choose(positive: DataFrame, every: DataFrame, n_pos: int, n_all: int) -> np.ndarray:
    """Buckets whose share among positives exceeds that among all documents by most standard errors."""
    counts = document_counts(positive).withColumnRenamed("n", "pos").where("pos >= 3").join(document_counts(every), "bucket")
    a, b = F.col("pos") / n_pos, F.col("n") / n_all
    both = (F.col("pos") + F.col("n")) / (n_pos + n_all)
    z = (a - b) / F.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_all) + 1e-12)
    top = counts.where(a > 1.5 * b).orderBy(F.round(z, 9).desc(), "bucket").limit(KEPT).select("bucket")
    return np.array(sorted(r.bucket for r in top.collect()), np.int64)


def features(kept: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """log(1 + count) and rate of the kept buckets for every document of a chunk, and log(1 + words)."""
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    n = len(off) - 1
    at = [d[own] * len(kept) + i[own] for i, d in ((place[b], d) for b, d in word_features(buf, off)) if (own := i >= 0).any()]
    out = np.bincount(np.concatenate(at), minlength=n * len(kept)) if at else np.zeros(n * len(kept), np.int64)
    out, words = out.reshape(n, len(kept)), np.diff(np.searchsorted(spans_of(WORDS[buf] != 0, off)[0], off))
    return np.concatenate([np.log1p(out), out / (words[:, None] + 20.0) * 20, np.log1p(words)[:, None] / 4], axis=1).astype(np.float32)


def _vectors(kept: np.ndarray):
    def run(batches):
        for rows, buf, off in chunks(batches):
            x = features(kept, buf, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("positive"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "positive", "features"])

    return run


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -60, 60)))


class Classifier:
    """A linear classifier fitted with the non-negative PU risk."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, beta: float = 0.0):
        n = positive.shape[1] if positive.ndim == 2 else 0
        self.w, self.b = np.full(n, 0.05, np.float32), np.float32(-1.0)
        if not len(positive) or not len(unlabelled) or not n:
            self.w = None
            return
        m, v = np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, steps + 1):
            p, u = _sigmoid(positive @ self.w + self.b), _sigmoid(unlabelled @ self.w + self.b)
            # sigmoid loss: a positive called negative costs p, and 1 - p the other way round
            slope_p, slope_u = p * (1 - p) / len(p), u * (1 - u) / len(u)
            if u.mean() - prior * p.mean() >= -beta:
                up, uu = -2 * prior * slope_p, slope_u
            else:
                up, uu = prior * slope_p, -slope_u
            g = np.concatenate([positive.T @ up.astype(np.float32) + unlabelled.T @ uu.astype(np.float32) + 1e-5 * self.w, [up.sum() + uu.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            self.w, self.b = (self.w - step[:-1]).astype(np.float32), np.float32(self.b - step[-1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(x)) if self.w is None else _sigmoid(x @ self.w + self.b).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = MAX_POSITIVE, most_unlabelled: int = MAX_UNLABELLED) -> tuple[np.ndarray, Classifier]:
    """(kept buckets, classifier) from the labelled rows and the documents given."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    empty = np.zeros((0, 0))
    if not count.pos:
        return np.zeros(0, np.int64), Classifier(empty, empty, 0.0)
    prior = min(max(count.pos / count.n, 1e-4), 0.9)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pos = samples.pick(known.where("label = 1").select("doc_id").distinct(), ["doc_id"], most=most).withColumn("positive", F.lit(1))
    unl = samples.pick(known.select("doc_id").distinct(), ["doc_id"], most=most_unlabelled, seed=23).withColumn("positive", F.lit(0))
    sample = saved(samples.texts_of(rows, pos.unionByName(unl)))
    positive = sample.where("positive = 1")
    kept = choose(positive, rows, max(1, positive.count()), max(1, rows.count()))
    got = sample.mapInArrow(_vectors(kept), "doc_id long, positive int, features binary").toArrow()
    x = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32).reshape(got.num_rows, 2 * len(kept) + 1)
    y, ids = got.column("positive").to_numpy(), got.column("doc_id").to_numpy()
    order = np.lexsort((y, ids))
    x, y = x[order].astype(np.float32), y[order]
    return kept, Classifier(x[y == 1], x[y == 0], prior)


def score(docs: DataFrame, kept: np.ndarray, model: Classifier, held_out: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Probability of label 1 for every row; a narrow pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in chunks(batches):
            p = model.probability(features(kept, buf, off)) if len(kept) else np.zeros(rows.num_rows)
            yield batch(_ARROW, doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), score=p, predicted=(p >= threshold).astype(np.int32))

    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels and word counts from the rows whose fold of three is not 1, a score for every row."""
    usable = samples.fold(3) != 1
    kept, model = train(docs.where(usable), labels.where(usable))
    return score(docs, kept, model, samples.fold(3) == 1)
