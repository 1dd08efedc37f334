"""Hard-negative mining by dual-tree search.

Anchors and candidates each have a tree. Its upper part is over blocks: rows are put in order of
label, cell of a k-d tree and id, numbered without a single task, and cut into blocks of a
bounded size (so a label, or a vector, that a third of the rows have fills many blocks). A block
is one packed row with its centre, its radius and its least and greatest label; blocks of blocks
have the same, up to one root. Spark descends both trees together, a level at a time, by joins with
the children of the pairs that are left: the inner products of two nodes lie within
``c . d +- (|c| s + |d| r + r s)`` (centres c and d, radii r and s), and a pair whose interval or whose labels
cannot serve any anchor of the node goes. A task goes on inside a pair of blocks, in the same way, over trees of
their rows; pairs of leaves are scored exactly, in integers. The least score that can still enter the
results rises with each leaf, and a first search of the nearest blocks gives a start for it.

There are two searches. The first finds each anchor's positives, its ``positives`` best rows of the same label. In
the second each anchor and positive has a window of scores, from ``low`` to ``high`` per cent of the positive's,
and gets the ``negatives`` best rows of another label inside it. Equal scores go by the smaller id.

The k-d tree's splits come from a bounded sample (``SAMPLE`` rows, chosen by a hash); they decide only what
lies near what. Every row is searched and no number of candidates is limited, so results are those of
comparing all. Where vectors have no structure the intervals are wide and most pairs of leaves are scored.

Defined results: rows with a null id, label or vector, or with a component that is null, not finite or above
``MOST`` units in size (so that scores fit a long), take no part; a vector is as if zeros followed it. An anchor never gets a row of its
own id. Rows that repeat an id each take part; an anchor that repeats as a whole counts once. An anchor
without positives, or a positive without rows in its window, gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import numbered
from .tables import saved

#: Bytes of vectors in a candidate block and in an anchor block; blocks that a task gets at once; children of a node.
BLOCK_BYTES, ANCHOR_BYTES, CHUNK, FAN = 1 << 20, 1 << 17, 4, 16
#: Rows in a leaf of the trees inside a block of candidates and a block of anchors.
LEAF, ANCHOR_LEAF = 64, 8
#: Rows that the k-d tree is fitted on, and its depth.
SAMPLE, DEPTH = 8_192, 10
MOST = 1 << 22
_NONE = -(1 << 62)

_BLOCK = "block long, ids binary, labels binary, vectors binary, size long, center array<double>, radius double, low long, high long"
_NODE = "node long, size long, center array<double>, radius double, low long, high long"
_FOUND = pa.schema([("query", pa.int64()), ("anchor", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def quantised(rows: DataFrame, id_col: str, vector_col: str, label: Column, anchor: Column, scale: int) -> DataFrame:
    """(id, label, q, anchor) of the rows that take part; q has the components as integers."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= MOST))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"), sound.alias("sound"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND sound")
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("q"), "anchor")


def _matrix(q: pa.Array, dims: int) -> np.ndarray:
    """A column of integer lists as a matrix, with zeros behind short ones."""
    q = q.combine_chunks() if isinstance(q, pa.ChunkedArray) else q
    size = np.diff(q.offsets.to_numpy())
    out = np.zeros((len(q), dims), np.int32)
    row = np.repeat(np.arange(len(q)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = q.flatten().to_numpy()
    return out


def _splits(sample: np.ndarray, depth: int) -> tuple[list[int], list[int]]:
    """A k-d tree in heap order: (dimension, cut) of each inner node, at the median of the widest spread."""
    dims, cuts = [0] * (1 << depth), [0] * (1 << depth)
    own = {1: sample}
    for node in range(1, 1 << depth):
        x = own.pop(node)
        if len(x):
            dims[node] = int(np.argmax(x.max(0).astype(np.int64) - x.min(0)))
            cuts[node] = int(np.median(x[:, dims[node]]))
        right = x[:, dims[node]] > cuts[node]
        own[2 * node], own[2 * node + 1] = x[~right], x[right]
    return dims, cuts


def _celled(rows: DataFrame, dims: int) -> DataFrame:
    """Rows with the cell of the k-d tree that they fall into."""
    depth = DEPTH if dims else 0
    at = F.lit(1)
    if depth:
        sample = rows.select("q", F.xxhash64("id", "q").alias("_h")).orderBy("_h", "q").limit(SAMPLE).select("q").toArrow()
        d, c = _splits(_matrix(sample.column("q"), dims), depth)
        step = lambda node, _: node * 2 + (F.coalesce(F.get("q", F.get(F.lit(d), node)), F.lit(0)) > F.get(F.lit(c), node)).cast("int")
        at = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), step)
    return rows.withColumn("cell", at)


def _packed(rows: DataFrame, per_block: int, dims: int) -> DataFrame:
    """Blocks of ``per_block`` rows, in order of label, cell and id: a packed row each."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("n")
        v = _matrix(t.column("q"), dims)
        c = v.mean(0)
        r = float(np.sqrt(((v - c) ** 2).sum(1)).max())
        label = t.column("label").to_numpy()
        one = {"block": [t.column("block")[0].as_py()], "ids": [t.column("id").to_numpy().tobytes()], "labels": [label.tobytes()], "vectors": [v.tobytes()], "size": [len(v)], "center": [c.tolist()], "radius": [r], "low": [int(label.min())], "high": [int(label.max())]}
        return pa.table(one, schema=_BLOCK_ARROW)

    rows = numbered(rows, ["label", "cell", "id"], "n").withColumn("block", F.floor(F.col("n") / per_block).cast("long"))
    return saved(rows.select("block", "n", "id", "label", "q").groupBy("block").applyInArrow(pack, _BLOCK))


_BLOCK_ARROW = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "vectors")), ("size", pa.int64()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("low", pa.int64()), ("high", pa.int64())])
_NODE_ARROW = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("center", pa.list_(pa.float64())), ("radius", pa.float64()), ("low", pa.int64()), ("high", pa.int64())])


def _levels(blocks: DataFrame, height: int) -> list[DataFrame]:
    """The nodes over the blocks, from the blocks themselves to the root: at most ``FAN`` children each."""

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        size, c = t.column("size").to_numpy(), np.array(t.column("center").to_pylist(), float)
        mid = size @ c / size.sum()
        r = float((np.sqrt(((c - mid) ** 2).sum(1)) + t.column("radius").to_numpy()).max())
        one = {"node": [t.column("parent")[0].as_py()], "size": [int(size.sum())], "center": [mid.tolist()], "radius": [r], "low": [int(t.column("low").to_numpy().min())], "high": [int(t.column("high").to_numpy().max())]}
        return pa.table(one, schema=_NODE_ARROW)

    out = [blocks.select(F.col("block").alias("node"), "size", "center", "radius", "low", "high")]
    for _ in range(height):
        out.append(saved(out[-1].withColumn("parent", F.floor(F.col("node") / FAN).cast("long")).groupBy("parent").applyInArrow(join, _NODE)))
    return out


def _bounded(pairs: DataFrame, same: bool) -> DataFrame:
    """Node pairs (a, c) with the interval of their inner products, where their labels can serve."""
    sum_of = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norm = lambda side: F.sqrt(sum_of(f"{side}.center", f"{side}.center"))
    mid = sum_of("a.center", "c.center")
    slack = (norm("a") * F.col("c.radius") + norm("c") * F.col("a.radius") + F.col("a.radius") * F.col("c.radius")) * (1 + 1e-9) + 1.0
    fits = (F.col("a.low") <= F.col("c.high")) & (F.col("c.low") <= F.col("a.high"))
    if not same:
        fits = ~((F.col("a.low") == F.col("a.high")) & (F.col("a.low") == F.col("c.low")) & (F.col("a.low") == F.col("c.high")))
    return pairs.where(fits).select(F.col("a.node").alias("a"), F.col("c.node").alias("c"), mid.alias("mid"), (mid - slack).alias("least"), (mid + slack).alias("most"))


def _descend(anchors: list[DataFrame], candidates: list[DataFrame], same: bool, queries: DataFrame, nearest: int = 0) -> DataFrame:
    """Pairs of blocks (a, c, mid) that may hold results: both trees are descended together, level by level.

    A pair stays if its interval meets the window of an anchor in the node; with ``nearest``, only so many of the
    closest nodes stay for each node of anchors.
    """
    pairs = anchors[-1].alias("a").join(candidates[-1].alias("c"), F.col("a.node") == F.col("c.node"))  # the two roots
    for level in range(len(anchors) - 1, -1, -1):
        up = F.floor(F.col("node") / FAN).cast("long")
        if level < len(anchors) - 1:
            left = anchors[level].withColumn("parent", up).alias("a")
            right = candidates[level].withColumn("parent", up).alias("c")
            pairs = pairs.select(F.col("a").alias("_a"), F.col("c").alias("_c")).join(left, F.col("_a") == F.col("a.parent")).join(right, F.col("_c") == F.col("c.parent"))
        window = queries.groupBy(F.floor(F.col("block") / FAN**level).cast("long").alias("w")).agg(F.min("least").alias("w_least"), F.max("most").alias("w_most"))
        pairs = _bounded(pairs, same).join(window, F.col("a") == F.col("w")).where("most >= w_least AND least <= w_most").select("a", "c", "mid")
        if nearest:
            near = Window.partitionBy("a").orderBy(F.desc("mid"), "c")
            pairs = pairs.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= nearest).drop("_r")
    return pairs


class _Tree:
    """A balanced tree of a block's rows, split along the line between two far rows, at the widest gap of the middle half; level by level, its nodes' balls."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf_size: int):
        order, edges = np.arange(len(v)), np.array([0, len(v)])
        height = max(0, int(np.log2(max(1, len(v) / leaf_size))))
        cuts = [edges]
        for below in range(height - 1, -1, -1):
            mids = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                own = v[order[a:b]]
                end = own[np.argmax(((own - own[0]) ** 2).sum(1))]  # far from the first row; the far end from there gives the direction
                by = own @ (own[np.argmax(((own - end) ** 2).sum(1))] - end)
                by_place = np.argsort(by, kind="stable")
                order[a:b] = order[a:b][by_place]
                # at the widest gap of the middle half; each half has rows for all its leaves
                lo, hi = max((b - a) // 4, 1 << below), min(b - a - (b - a) // 4, b - a - (1 << below))
                mids.append(a + lo + int(np.argmax(np.diff(by[by_place])[lo - 1 : hi])))
            edges = np.sort(np.concatenate([edges, mids]))
            cuts.append(edges)
        leaf = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        order = order[np.lexsort((ids[order], leaf))]  # ids ascend inside a leaf, so that equal scores are in order
        self.v, self.ids, self.labels, self.edges = v[order], ids[order], labels[order], edges
        self.order, self.leaf = order, leaf
        self.balls = []
        for e in cuts:
            size = np.diff(e)
            c = np.add.reduceat(self.v, e[:-1], axis=0) / size[:, None]
            r = np.sqrt(np.maximum.reduceat(((self.v - np.repeat(c, size, axis=0)) ** 2).sum(1), e[:-1]))
            self.balls.append((c, r, np.sqrt((c**2).sum(1)), np.minimum.reduceat(self.labels, e[:-1]), np.maximum.reduceat(self.labels, e[:-1])))


class Search:
    """The queries of an anchor block and the best rows found for each so far."""

    def __init__(self, anchors: _Tree, at: np.ndarray, query: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool):
        place = np.empty(len(anchors.order), np.int64)
        place[anchors.order] = np.arange(len(anchors.order))
        order = np.argsort(place[at], kind="stable")
        self.a, self.k, self.same = anchors, k, same
        self.at, self.query, self.most = place[at][order], query[order], most[order]
        self.least = least[order].copy()
        self.score, self.id = np.full((len(at), k), _NONE, np.int64), np.full((len(at), k), np.iinfo(np.int64).max)
        self.first = np.searchsorted(self.at, anchors.edges)  # of each leaf's queries
        self.scored = 0

    def _windows(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(least, most) that the queries under each node want, level by level."""
        n = len(self.a.edges) - 1
        lo, hi = np.full(n, -_NONE), np.full(n, _NONE)
        leaf = self.a.leaf[self.at]
        np.minimum.at(lo, leaf, self.least)
        np.maximum.at(hi, leaf, self.most)
        out = [(lo, hi)]
        while len(out[-1][0]) > 1:
            out.append((out[-1][0].reshape(-1, 2).min(1), out[-1][1].reshape(-1, 2).max(1)))
        return out[::-1]

    def run(self, c: _Tree) -> None:
        """Descend both trees; score the pairs of leaves that are left, those with the highest bound first."""
        window = self._windows()
        i = j = np.zeros(1, np.int64)
        la = lc = 0
        while True:
            (ca, ra, na, alo, ahi), (cc, rc, nc, clo, chi) = self.a.balls[la], c.balls[lc]
            mid = np.einsum("ij,ij->i", ca[i], cc[j])
            slack = (na[i] * rc[j] + nc[j] * ra[i] + ra[i] * rc[j]) * (1 + 1e-9) + 1.0
            fits = (alo[i] <= chi[j]) & (clo[j] <= ahi[i]) if self.same else ~((alo[i] == ahi[i]) & (clo[j] == chi[j]) & (alo[i] == clo[j]))
            keep = fits & (mid + slack >= window[la][0][i]) & (mid - slack <= window[la][1][i])
            i, j, top = i[keep], j[keep], (mid + slack)[keep]
            down_a, down_c = la + 1 < len(self.a.balls), lc + 1 < len(c.balls)
            if not (down_a or down_c) or not len(i):
                break
            if down_a:
                i, j, la = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), la + 1
            if down_c:
                i, j, lc = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), lc + 1
        for k in np.lexsort((-top, i)).tolist():
            q = slice(self.first[i[k]], self.first[i[k] + 1])
            if top[k] >= self.least[q].min(initial=-_NONE):
                self._leaves(q, i[k], slice(c.edges[j[k]], c.edges[j[k] + 1]), c)

    def _leaves(self, q: slice, leaf: int, rows: slice, c: _Tree) -> None:
        a = slice(self.a.edges[leaf], self.a.edges[leaf + 1])
        scores = np.rint(self.a.v[a] @ c.v[rows].T).astype(np.int64) if self.exact(c) else self.a.v[a].astype(np.int64) @ c.v[rows].T.astype(np.int64)
        self.scored += scores.size
        own = self.at[q] - a.start
        s = scores[own]
        alike = (self.a.labels[a][:, None] == c.labels[rows])[own]
        ok = (s >= self.least[q][:, None]) & (s <= self.most[q][:, None]) & (alike if self.same else ~alike) & (self.a.ids[a][own][:, None] != c.ids[rows])
        hit = np.flatnonzero(ok.any(1))
        if not len(hit):
            return
        s = np.where(ok[hit], s[hit], _NONE)
        top = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
        s = np.take_along_axis(s, top, 1)
        ids = np.where(s > _NONE, c.ids[rows][top], np.iinfo(np.int64).max)
        hit = hit + q.start
        s, ids = np.concatenate([self.score[hit], s], 1), np.concatenate([self.id[hit], ids], 1)
        best = np.lexsort((ids, -s), axis=1)[:, : self.k]
        self.score[hit], self.id[hit] = np.take_along_axis(s, best, 1), np.take_along_axis(ids, best, 1)
        self.least[hit] = np.maximum(self.least[hit], self.score[hit, -1])

    def exact(self, c: _Tree) -> bool:
        """Whether sums of products fit a double's whole numbers."""
        return float(np.abs(self.a.v).max(initial=0)) * float(np.abs(c.v).max(initial=0)) * max(1, c.v.shape[1]) < 2.0**53

    def found(self) -> pa.Table:
        own = self.score > _NONE
        n = own.sum(1)
        return pa.table([np.repeat(self.query, n), np.repeat(self.a.ids[self.at], n), self.id[own], self.score[own]], schema=_FOUND)


def _tree(leaf_size: int, ids: bytes, labels: bytes, vectors: bytes) -> _Tree:
    ids = np.frombuffer(ids, np.int64)
    return _Tree(np.frombuffer(vectors, np.int32).reshape(len(ids), -1).astype(float), ids, np.frombuffer(labels, np.int64), leaf_size)


def _queries(queries: DataFrame) -> DataFrame:
    """Each anchor block's queries in one packed row: place of the anchor in its block, number, window."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("query")
        return pa.table({"block": [t.column("block")[0].as_py()], **{f"q_{c}": [t.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("at", "query", "least", "most")}}, schema=pa.schema([("block", pa.int64()), *((f"q_{c}", pa.binary()) for c in ("at", "query", "least", "most"))]))

    return queries.select("block", "at", "query", "least", "most").groupBy("block").applyInArrow(pack, "block long, q_at binary, q_query binary, q_least binary, q_most binary")


def _search(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """(query, anchor, id, score): for each query the best ``k`` of each chunk of candidate blocks that is paired with its anchors."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("mid", "descending"), ("c", "ascending")])
        one = lambda c, i=0: t.column(c)[i].as_py()
        numbers = [np.frombuffer(one(f"q_{c}"), np.int64) for c in ("at", "query", "least", "most")]
        s = Search(_tree(ANCHOR_LEAF, one("a_ids"), one("a_labels"), one("a_vectors")), *numbers, k, same)
        for i in range(t.num_rows):
            s.run(_tree(LEAF, one("ids", i), one("labels", i), one("vectors", i)))
        return s.found()

    left = anchors.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "vectors")]).join(_queries(queries).withColumnRenamed("block", "a"), "a")
    rows = pairs.join(candidates.select(F.col("block").alias("c"), "ids", "labels", "vectors"), "c").join(left, "a")
    return rows.withColumn("chunk", F.floor(F.col("c") / CHUNK)).groupBy("a", "chunk").applyInArrow(run, "query long, anchor long, id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _two_rounds(trees: tuple, queries: DataFrame, same: bool, k: int) -> DataFrame:
    """The best ``k`` of each query, (query, id, score, rank): the nearest blocks first, then what can still do better."""
    anchors, candidates, a_levels, c_levels = trees
    near = saved(_descend(a_levels, c_levels, same, queries, nearest=2))
    first = saved(_best(_search(near, anchors, candidates, queries, same, k), k).drop("rank"))
    full = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
    rest = saved(queries.join(full, "query", "left").withColumn("least", F.greatest("least", F.coalesce("reached", "least"))).drop("reached"))
    pairs = saved(_descend(a_levels, c_levels, same, rest).join(near.select("a", "c"), ["a", "c"], "left_anti"))
    return saved(_best(first.unionByName(_search(pairs, anchors, candidates, rest, same, k)), k))


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``anchor`` holds for.

    A negative's score lies from ``low`` to ``high`` per cent of its positive's, ends included.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = quantised(rows, id_col, vector_col, label, anchor, scale)
    spark, out = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    known = rows.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("q")).alias("dims")).first()
    if not known.a:
        return spark.createDataFrame([], out)
    dims = max(1, known.dims)
    per_block, per_anchors = (max(2, b // (4 * dims)) for b in (BLOCK_BYTES, ANCHOR_BYTES))
    celled = _celled(rows, dims)
    candidates = _packed(celled.drop("anchor"), per_block, dims)
    anchors = _packed(celled.where("anchor").drop("anchor").dropDuplicates(["id", "label", "q"]), per_anchors, dims)
    height, n = 0, max(-(-known.n // per_block), -(-known.a // per_anchors))
    while n > 1:
        height, n = height + 1, -(-n // FAN)
    trees = anchors, candidates, _levels(anchors, height), _levels(candidates, height)
    every = anchors.select("block", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at"))
    number = F.col("block") * per_anchors + F.col("at")
    asked = saved(every.select("block", "at", number.alias("query"), F.lit(_NONE + 1).alias("least"), F.lit(-_NONE).alias("most")))
    best = _two_rounds(trees, asked, True, positives)
    # of each positive: its anchor's place and the window of its negatives
    pos = best.where("score >= 0").select(
        F.floor(F.col("query") / per_anchors).cast("long").alias("block"), F.pmod("query", F.lit(per_anchors)).alias("at"), (F.col("query") * positives + F.col("rank") - 1).alias("query"),
        F.col("anchor").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.expr(f"({low} * score + 99) div 100").alias("least"), F.expr(f"({high} * score) div 100").alias("most"),
    ).where("least <= most")
    pos = saved(pos)
    worst = _two_rounds(trees, pos.select("block", "at", "query", "least", "most"), False, negatives)
    found = worst.select("query", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return pos.join(found, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
