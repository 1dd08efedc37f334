"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: each token has a sparse random index vector (``NONZERO`` entries of +1 or
-1 in ``DIM`` dimensions); a token's word vector is the sum of the index vectors of its
neighbours within ``REACH`` places, over all documents of the input. Tokens are words
(lower-cased, each followed by a token for its shape) and runs of marks; they are hashed
to ``BUCKETS`` rows, so the table has a fixed size. Each task of the scan sums a table
and sends the rows that it met; those are added up by block of rows, in streams, first in ``FAN_IN`` parts and then once more.

A document is the mean of its tokens' word vectors (drawn towards zero for short texts by
``PRIOR_TOKENS``) and their spread around it in each dimension; nothing else is known of
it. A network with one hidden layer, fitted in numpy on at most ``MAX_ROWS`` labelled rows,
gives a logit; a temperature that minimises the log loss on a part of those rows kept aside
calibrates the probability.

Defined results: null counts as empty; a text without a token has a vector of zeros and is
scored as such; labels that are null are ignored; without labels of both classes the score
is the share of label 1 (0.5 if there is none); with so few that the part kept aside or the
rest lacks a class, the temperature is 1 and all rows are fitted on; rows that repeat an id
are scored each on its own, and count as one where they are learned from; columns besides
those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples
from .textbuf import batch, chunks, span_hashes, spans_of

DIM, BUCKETS, NONZERO, REACH, BLOCKS = 48, 1 << 16, 2, 2, 64
FAN_IN, HELD_TOKENS = 64, 2_000_000
HIDDEN, EPOCHS = 24, 60
THRESHOLD = 0.7

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
_FEATURES, PRIOR_TOKENS, GATHER = 2 * DIM, 8, 65_536


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind (0 space, 1 word, 2 mark) and lower-cased value of each byte."""
    kind, low = np.full(256, 2, np.uint8), np.arange(256, dtype=np.uint8)
    kind[:33] = 0
    kind[0x30:0x3A] = kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:] = 1
    low[0x41:0x5B] += 32
    return kind, low


KIND, LOW = _byte_kinds()


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every token, in order. A word is followed by the token of its shape."""
    kind, low = KIND[buf], LOW[buf]
    ws, we = spans_of(kind == 1, off)
    ms, me = spans_of(kind == 2, off)
    upper = np.concatenate([[0], np.cumsum((buf >= 0x41) & (buf <= 0x5A))])
    digit = np.concatenate([[0], np.cumsum((buf >= 0x30) & (buf <= 0x39))])
    n_up, n_dig = upper[we] - upper[ws], digit[we] - digit[ws]
    # shape: digits, one capital at the start, more capitals, or none; short, middle or long
    shape = np.where(n_dig > 0, 3, np.where(n_up >= 2, 2, np.minimum(n_up, 1))) * 3 + np.digitize(we - ws, [4, 12])
    h = (span_hashes(low, ws, we) % np.uint64(BUCKETS - 64)).astype(np.int64) + 64
    m = (span_hashes(buf, ms, me) % np.uint64(BUCKETS - 64)).astype(np.int64) + 64
    where = np.concatenate([ws, ws, ms])
    rank = np.repeat([0, 1, 0], [len(ws), len(ws), len(ms)])
    order = np.argsort(where * 2 + rank, kind="stable")
    return np.concatenate([h, shape, m])[order], np.searchsorted(off, where[order], "right") - 1


def index_vectors(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each token's index vector."""
    r = np.random.default_rng(seed)
    return r.integers(0, DIM, (BUCKETS, NONZERO)), r.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sum of neighbours' index vectors by token, and token counts; one row per block of the table."""
    place, sign = index_vectors()
    table, count = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        tok, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        count[:] += np.bincount(tok, minlength=BUCKETS)
        for gap in range(1, REACH + 1):
            same = doc[gap:] == doc[:-gap]
            a, b = tok[:-gap][same], tok[gap:][same]
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    table[:] += np.bincount(x * DIM + place[y, k], sign[y, k], BUCKETS * DIM)

    docs = size = 0
    for rows, buf, off in chunks(batches):
        tok, doc = tokens(buf, off)
        held.append((tok, doc + docs))
        docs, size = docs + rows.num_rows, size + len(tok)
        if size >= HELD_TOKENS:
            add()
            held, size = [], 0
    if held:
        add()
    sums, wide = np.concatenate([table.reshape(BUCKETS, DIM), count[:, None]], axis=1), BUCKETS // BLOCKS
    for k in range(BLOCKS):
        met = np.flatnonzero(count[k * wide : (k + 1) * wide])
        if len(met):
            yield _sum_row(k, met, sums[k * wide + met].astype(np.float32))


_SUMS = "block int, rows binary, sums binary"


def _sum_row(block: int, met: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([met.astype(np.int32).tobytes()], pa.binary()), pa.array([sums.tobytes()], pa.binary())], names=["block", "rows", "sums"])


def _adder(kind: type):
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum the rows of each block, one row in memory besides the sums."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, met, v in zip(b.column("block").to_pylist(), b.column("rows"), b.column("sums"), strict=True):
                sums = total.setdefault(k, np.zeros((BUCKETS // BLOCKS, DIM + 1)))
                sums[np.frombuffer(met.as_buffer(), np.int32)] += np.frombuffer(v.as_buffer(), kind).reshape(-1, DIM + 1)
        for k, v in total.items():
            yield _sum_row(k, np.flatnonzero(v[:, DIM]), v[v[:, DIM] > 0])

    return add_up


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vector of every bucket, from all documents; the driver gets the one table, of fixed size."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the scan keeps its tasks; their sums are added in two levels, so that no task reads those of all
    parts = rows.mapInArrow(_contexts, _SUMS).repartition("block", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).mapInArrow(_adder(np.float32), _SUMS)
    sums = parts.repartition(BLOCKS, "block").mapInArrow(_adder(np.float64), _SUMS)
    table = np.zeros((BUCKETS, DIM + 1))
    for block, met, v in sums.toLocalIterator():
        table[block * (BUCKETS // BLOCKS) + np.frombuffer(met, np.int32)] = np.frombuffer(v, np.float64).reshape(-1, DIM + 1)
    v, n = table[:, :DIM], table[:, DIM:]
    # what sets a token's contexts apart from the average context
    v = v / np.maximum(n, 1) - v.sum(axis=0) / max(n.sum(), 1)
    v[n[:, 0] == 0] = 0
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of every document of a chunk."""
    n = len(off) - 1
    tok, doc = tokens(buf, off)
    out = np.zeros((n, _FEATURES), np.float32)
    if not len(tok):
        return out
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)[:, None]
    a = 0
    while a < n:
        # documents of at most GATHER tokens together; a longer one by its counts
        b = max(a + 1, int(np.searchsorted(first, first[a] + GATHER, "right")) - 1)
        x, y = first[a], first[b]
        if y - x > GATHER:
            count = np.bincount(tok[x:y], minlength=BUCKETS).astype(np.float32)
            out[a, :DIM], out[a, DIM:] = count @ vectors, count @ (vectors * vectors)
        elif x < y:
            own = np.flatnonzero(size[a:b]) + a
            v = vectors[tok[x:y]]
            out[own, :DIM] = np.add.reduceat(v, first[own] - x, axis=0)
            out[own, DIM:] = np.add.reduceat(v * v, first[own] - x, axis=0)
        a = b
    mean = out[:, :DIM] / np.maximum(size, 1)
    out[:, DIM:] = np.sqrt(np.maximum(out[:, DIM:] / np.maximum(size, 1) - mean * mean, 0))
    out[:, :DIM] /= size + PRIOR_TOKENS
    return out


def _features(vectors: Broadcast):
    def run(batches):
        for rows, buf, off in chunks(batches):
            f = pooled(vectors.value, buf, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("label"), pa.array([x.tobytes() for x in f], pa.binary())], names=["doc_id", "label", "features"])

    return run


class Network:
    """features -> tanh layer -> logit / temperature -> probability."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        self.temperature, self.constant = 1.0, None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        cut = max(1, len(y) // 5)
        aside, fit = order[:cut], order[cut:]
        known = all(len(set(y[own].tolist())) == 2 for own in (aside, fit))
        if not known:
            fit = order
        z = (x - self.mean) / self.scale
        self.p = [r.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for _ in range(EPOCHS):
            for own in np.array_split(r.permutation(fit), max(1, len(fit) // 128)):
                t += 1
                for k, g in enumerate(self._gradient(z[own], y[own])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if not known:
            return
        logit = self._logit(z[aside])
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.logaddexp(0, -(2 * y[aside] - 1) * logit / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def _gradient(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y) / len(y)
        back = d[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logit((x - self.mean) / self.scale) / self.temperature, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, vectors: Broadcast, label_col: str = "quality", most: int = samples.MAX_ROWS) -> Network:
    """Fit on at most ``most`` of the labelled rows given."""
    known = labels.where(F.col(label_col).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    sample = samples.pick(known, ["doc_id", "label"], most=most)
    got = samples.texts_of(docs, sample).mapInArrow(_features(vectors), "doc_id long, label int, features binary").toArrow()
    x = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32).reshape(-1, _FEATURES).astype(np.float64)
    y, ids = got.column("label").to_numpy().astype(np.float64), got.column("doc_id").to_numpy()
    order = np.lexsort((y, ids))  # rows arrive in any order; the fit must not depend on it
    return Network(x[order], y[order])


def score(docs: DataFrame, vectors: Broadcast, net: Network, held_out: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Probability of label 1 for every row; a narrow pass, nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in chunks(batches):
            p = net.probability(pooled(vectors.value, buf, off).astype(np.float64))
            yield batch(_ARROW, doc_id=rows.column("doc_id"), held_out=rows.column("held_out"), score=p, predicted=(p >= threshold).astype(np.int32))

    flag = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Word vectors from all documents, labels from the rows whose fold of four is not 2, a score for every row."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))  # BUCKETS x DIM, whatever the input
    net = train(docs, labels.where(samples.fold(4) != 2), vectors)
    return score(docs, vectors, net, samples.fold(4) == 2)
