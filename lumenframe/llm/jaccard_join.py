"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

A document is the set of its five-word shingles (words as in decontamination; a text of
fewer words, but not none, is one shingle). Words are told apart by their bytes and named
by 64 bits of their BLAKE2b digest, a shingle by a mix of its words' names: two shingles
that differ are taken for equal with a chance of 2**-64 a pair. Documents with the same set
(128 bits name it) form one class and go on as one node.

The forest has ``TREES`` prefix tries. In tree t the path of a node is a string of MinHash
values, in byte order, so that a prefix of the string is a node of the trie. A trie is a
table of (prefix, least member, members), and two nodes that share a prefix are candidates.
Every node shortens its prefixes on its own: it starts at the longest length at which the
chance to meet a partner at the threshold reaches the target recall (``prefix_depth``), and
goes on, one value at a time down to ``SHORTEST``, while the shorter prefixes match at most
``FEW`` nodes in all trees together. So nodes in sparse parts of the tries end at short
prefixes and a higher recall, nodes in crowded parts at the length that the target asks
for, and never below the target. Parts of a trie in which a node is alone are cut off first.

Candidates are verified exactly before anything is linked. A node's home is the least node
of the most crowded of its prefixes, so the nodes of a crowded prefix have other homes only where still more
crowded ones lead there; a home's nodes are cut into blocks of bounded size. Pairs of
blocks of one home, and pairs of blocks of different homes that share a prefix, are groups
of rows in which a task compares the shingle sets; a pair of nodes meets in one group only.
A node goes to another home's block only if it has a candidate there, so candidates that
merely hang together bring no rows together. Components are then made of verified links. No
rows stand for pairs, and every link is counted.

Result, one row per document: doc_id, class_id (least doc_id of the component of verified
links), n_links (other documents with a similarity of at least the threshold: copies of
the set and members of linked classes), set_size, n_shingles.

Defined results: null counts as empty; a document without a word is alone, with no links,
whatever others are empty; rows that repeat an id and a text are copies of each other; rows
that share an id but not the text are documents of their own; a null id counts as the least
id and makes a null class_id; an empty input gives an empty result; columns besides id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, saved, unused
from .textbuf import chunks, mix, strong_words

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, SHORTEST, TARGET = 24, 8, 3, 0.9999
FEW = 16
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1_000_000
_NO_ID = -(1 << 63)


def recall(depth: int, trees: int, similarity: float) -> float:
    """Chance that two sets of that similarity share a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(target: float = TARGET, trees: int = TREES, deepest: int = DEEPEST, similarity: float = THRESHOLD) -> int:
    """The longest prefix that reaches the target recall; every node looks at least as far."""
    depth = deepest
    while depth > 1 and recall(depth, trees, similarity) < target:
        depth -= 1
    return depth


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle names, first index of each document and the total), sorted within each document."""
    h, first = strong_words(buf, off)
    n, count = len(off) - 1, np.diff(first)
    size = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(n), size)
    at = np.repeat(first[:-1] - (np.cumsum(size) - size), size) + np.arange(len(doc))
    reach = np.minimum(count, width)[doc]
    out = reach.astype(np.uint64)
    for j in range(width):
        if len(own := np.flatnonzero(reach > j)) == len(out):
            out = mix(out + h[at + j])
        else:
            out[own] = mix(out[own] + h[at[own] + j])
    order = np.lexsort((out, doc))
    out = out[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.searchsorted(doc[new], np.arange(n + 1))


def paths(sets: np.ndarray, first: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """A row of bytes per document and tree: the tree's number, then two bytes for each MinHash value."""
    n = len(first) - 1
    out = np.zeros((n, trees, 1 + 2 * depth), np.uint8)
    out[:, :, 0] = np.arange(trees)
    own = np.flatnonzero(np.diff(first))
    if not len(own):
        return out
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = (sets & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    r = np.random.default_rng(71)
    a, b = r.integers(0, 1 << 31, (2, trees, depth), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    heads = first[own]
    for t in range(trees):
        for d in range(depth):
            # two 32-bit halves, multiplied by odd numbers of their own: a cheap new order of the set
            least = np.minimum.reduceat(x * a[t, d] + (low ^ b[t, d]) * np.uint32(0x9E3779B1), heads)
            least = (least ^ least >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            out[own, t, 1 + 2 * d], out[own, t, 2 + 2 * d] = least >> np.uint32(24), least >> np.uint32(16) & np.uint32(255)
    return out


def _signer(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 1 + 2 * depth
        for rows, buf, off in chunks(batches):
            sets, first = shingle_sets(buf, off)
            n = np.diff(first)
            nodes = _node_names(sets, first)
            flat = paths(sets, first, depth)
            strings = pa.Array.from_buffers(pa.binary(), len(n) * TREES, [None, pa.py_buffer(np.arange(len(n) * TREES + 1, dtype=np.int32) * width), pa.py_buffer(flat.tobytes())])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TREES), strings)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), pa.array(nodes, pa.binary()), pa.array(n, pa.int64()), lists], names=["doc_id", "text_key", "node", "n", "paths"])

    return run


def _node_names(sets: np.ndarray, first: np.ndarray) -> list[bytes]:
    """128 bits of the BLAKE2b digest of each sorted set."""
    raw, cut = memoryview(sets.astype("<u8", copy=False)).cast("B"), (8 * first).tolist()
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets in place of texts."""
    names = ["node", "size", "routes"]
    for rows, buf, off in chunks(batches):
        sets, first = shingle_sets(buf, off)
        cut = first.tolist()
        packed = [sets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(c) for c in names] + [pa.array(packed, pa.binary())], names=[*names, "shingles"])


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over the shingles that occur twice, some columns at a time."""
    every = np.concatenate(a + b)
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in a + b])
    keep = count[number] > 1
    place = np.cumsum(count > 1) - 1
    row, col = row[keep], place[number[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out, total = np.zeros((len(a), len(b)), np.float32), int(col[-1]) + 1 if len(col) else 0
    for c in range(0, total, 4096):
        x, y = np.searchsorted(col, [c, c + 4096])
        m = np.zeros((len(a) + len(b), min(4096, total - c)), np.float32)
        m[row[x:y], col[x:y] - c] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    """Boolean matrix: pairs whose exact similarity reaches the threshold."""
    na, nb = np.array([len(s) for s in sets_a], np.int64), np.array([len(s) for s in sets_b], np.int64)
    p, q = threshold.numerator, threshold.denominator
    near = (np.minimum(na[:, None], nb) * q >= np.maximum(na[:, None], nb) * p) & (na[:, None] > 0)
    pairs = np.argwhere(near)
    if not len(pairs):
        return near
    if len(pairs) <= 4 * (len(na) + len(nb)):
        both = np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in pairs.tolist()])
        near[pairs[:, 0], pairs[:, 1]] = both * q >= (na[pairs[:, 0]] + nb[pairs[:, 1]] - both) * p
        return near
    both = overlaps(sets_a, sets_b)
    return near & (both * q >= (na[:, None] + nb - both) * p)


_GROUP = ["left_home", "left_block", "right_home", "right_block"]


def _verifier(threshold: Fraction):
    def solve(rows: list[tuple]) -> list[tuple[bytes, bytes, int]]:
        """(node, least node it hangs together with here, documents linked) for each node of a group of (node, size, side, shingles)."""
        diagonal = rows[0][2] == 2
        a = [r for r in rows if r[2] != 1]
        b = a if diagonal else [r for r in rows if r[2] == 1]
        if not a or not b:
            return []
        sa = [np.frombuffer(r[3], np.uint64) for r in a]
        m = links(sa, sa if diagonal else [np.frombuffer(r[3], np.uint64) for r in b], threshold)
        every = a if diagonal else a + b
        if diagonal:
            np.fill_diagonal(m, False)
            i, j = np.nonzero(np.triu(m))
            degree = m @ np.array([r[1] for r in a], np.int64)
        else:
            i, j = np.nonzero(m)
            degree = np.concatenate([m @ np.array([r[1] for r in b], np.int64), m.T @ np.array([r[1] for r in a], np.int64)])
            j = j + len(a)
        parent = list(range(len(every)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            parent[root(x)] = root(y)
        least: dict[int, bytes] = {}
        for k, r in enumerate(every):
            c = root(k)
            least[c] = min(least.get(c, r[0]), r[0])
        return [(r[0], least[root(k)], int(degree[k])) for k, r in enumerate(every) if degree[k]]

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], names=["node", "least", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, key, out = [], None, []
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                keys = zip(*(part.column(c).to_pylist() for c in _GROUP), strict=True)
                rows = zip(*(part.column(c).to_pylist() for c in ("node", "size", "side", "shingles")), strict=True)
                for now, row in zip(keys, rows, strict=True):
                    if now != key:
                        if len(group) > 1:
                            out += solve(group)
                        group, key = [], now
                        if len(out) > 4096:
                            yield table(out)
                            out = []
                    if not group or group[-1][0] != row[0]:  # a row that stands twice comes twice
                        group.append(row)
        if len(group) > 1:
            out += solve(group)
        if out:
            yield table(out)

    return run


def _prefix(depth: int, path: str = "path"):
    return F.substring(path, 1, 1 + 2 * depth)


def candidate_groups(nodes: DataFrame, depth: int, shortest: int = SHORTEST, few: int = FEW) -> DataFrame:
    """(node, prefix, hub, members) of every prefix that two nodes or more share and that one of them is to look at.

    ``nodes`` has node and paths. All nodes look at prefixes of ``depth`` values; those with few matches at shorter ones too.
    """
    shortest = min(shortest, depth)
    every = nodes.select("node", F.explode("paths").alias("path"))
    # branches of the tries with more than one node; the others are cut off
    shared = every.groupBy(_prefix(shortest).alias("branch")).agg(F.count("*").alias("members")).where("members > 1").select("branch")
    live = saved(every.join(shared, _prefix(shortest) == F.col("branch"), "left_semi").select("node", "path"))
    levels = F.explode(F.array(*[F.struct(F.lit(d).alias("level"), _prefix(d).alias("prefix")) for d in range(depth, shortest - 1, -1)])).alias("l")
    steps = live.select("node", levels).select("node", "l.level", "l.prefix")
    trie = saved(steps.groupBy("prefix").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"))
    steps = saved(steps.join(trie, "prefix"))
    # how short a node's prefixes become: matches only grow on the way
    matches = [F.sum(F.when(F.col("level") == d, F.col("members") - 1).otherwise(0)).alias(f"m{d}") for d in range(shortest, depth)]
    reach = F.lit(depth)
    for d in range(depth - 1, shortest - 1, -1):
        reach = F.when((reach == d + 1) & (F.col(f"m{d}") <= few), F.lit(d)).otherwise(reach)
    if matches:
        ends = steps.groupBy("node").agg(*matches).select("node", reach.alias("end")).where(F.col("end") < depth)
        asked = steps.where(F.col("level") < depth).join(ends, "node").where("level >= end").select("prefix").distinct()
        steps = steps.where(F.col("level") == depth).unionByName(steps.where(F.col("level") < depth).join(asked, "prefix", "left_semi").select(*steps.columns))
    return steps.select("node", "prefix", "hub", "members")


def _routes(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, doc_id, text_key, size and the groups of the verification that it goes to."""
    home = F.min(F.struct(-F.col("members"), "hub"))["hub"].alias("home")
    placed = groups.groupBy("node").agg(home).join(nodes.select("node", "doc_id", "text_key", "size", "n"), "node")
    placed = saved(placed)
    shape = placed.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES), F.lit(1)).cast("int").alias("blocks"))
    # a table of its own: the join can then split a large home, or broadcast the shapes where they are few
    placed = saved(placed.join(saved(shape), "home").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).drop("n"))
    own = placed.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.col("blocks") - 1),
                lambda other: F.struct(
                    F.col("home").alias("left_home"), F.least("block", other).alias("left_block"), F.col("home").alias("right_home"), F.greatest("block", other).alias("right_block"),
                    F.when(F.col("block") == other, 2).when(F.col("block") < other, 0).otherwise(1).alias("side"),
                ),
            )
        ).alias("route"),
    )
    # prefixes whose nodes have different homes: each node goes to the blocks of the other homes there
    at = saved(groups.select("node", "prefix").join(placed.select("node", "home", "block"), "node"))
    mixed = at.groupBy("prefix").agg(F.min("home").alias("a"), F.max("home").alias("b")).where("a != b").select("prefix")
    at = saved(at.join(mixed, "prefix"))
    there = at.select("prefix", F.col("home").alias("home2"), F.col("block").alias("block2")).distinct()
    across = at.join(there, "prefix").where("home != home2").select("node", "home", "block", "home2", "block2").distinct()
    first = F.col("home") < F.col("home2")
    across = across.select(
        "node",
        F.when(first, F.struct(F.col("home").alias("left_home"), F.col("block").alias("left_block"), F.col("home2").alias("right_home"), F.col("block2").alias("right_block"), F.lit(0).alias("side")))
        .otherwise(F.struct(F.col("home2").alias("left_home"), F.col("block2").alias("left_block"), F.col("home").alias("right_home"), F.col("block").alias("right_block"), F.lit(1).alias("side")))
        .alias("route"),
    )
    routes = own.unionByName(across).groupBy("node").agg(F.collect_list("route").alias("routes"))
    return placed.select("node", "doc_id", "text_key", "size").join(routes, "node")


def _with_classes(docs: DataFrame, threshold: float, target: float, id_col: str, text_col: str) -> DataFrame:
    """The result with text_key (which with the id names the document) and component (null without a word)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    depth = prefix_depth(target, similarity=threshold)
    member = saved(rows.mapInArrow(_signer(depth), "doc_id long, text_key long, node binary, n long, paths array<binary>"))
    known = member.where("n > 0")
    nodes = known.groupBy("node").agg(F.min_by(F.struct("doc_id", "text_key", "n", "paths"), F.struct(F.coalesce("doc_id", F.lit(_NO_ID)), "text_key")).alias("r"), F.count("*").alias("size"), F.min("doc_id").alias("least_id"), F.max(F.col("doc_id").isNull()).alias("no_id"))
    nodes = saved(nodes.select("node", "size", F.when(~F.col("no_id"), F.col("least_id")).alias("least_id"), "r.doc_id", "r.text_key", "r.n", "r.paths"))
    routes = _routes(saved(candidate_groups(nodes.select("node", "paths"), depth)), nodes)
    id_ = F.coalesce("doc_id", F.lit(_NO_ID))
    wanted = routes.select(id_.alias("id"), "text_key", "node", "size", "routes")
    texts = rows.select(id_.alias("id"), "text_key", "text").join(wanted, ["id", "text_key"]).select("node", "size", "routes", "text")
    route = ", ".join(f"{c}: {'binary' if 'home' in c else 'int'}" for c in _GROUP)
    sets = texts.mapInArrow(_payload, f"node binary, size long, routes array<struct<{route}, side: int>>, shingles binary")
    sent = sets.select("node", "size", "shingles", F.explode("routes").alias("r")).select(*[f"r.{c}" for c in _GROUP], "r.side", "node", "size", "shingles")
    sent = sent.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")
    checked = saved(sent.mapInArrow(_verifier(Fraction(str(threshold))), "node binary, least binary, links long"))
    groups = components(checked.select(F.col("node").alias("a"), F.col("least").alias("b")))
    degree = checked.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "size", "least_id").join(groups, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = named.groupBy("component").agg(F.min(F.coalesce("least_id", F.lit(_NO_ID))).alias("c"))
    result = named.join(classes, "component").select("node", "component", "size", F.when(F.col("c") > _NO_ID, F.col("c")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    some = known.select("doc_id", "text_key", "node", "n").join(result, "node")
    some = some.select("doc_id", "text_key", "component", "class_id", (F.col("links") + F.col("size") - 1).alias("n_links"), F.col("size").alias("set_size"), F.col("n").alias("n_shingles"))
    none = member.where("n = 0").select("doc_id", "text_key", F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("set_size"), F.col("n").alias("n_shingles"))
    return some.unionByName(none)


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _with_classes(docs, threshold, target, id_col, text_col).drop("text_key", "component")


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns it came with: the one with the least id (a null id only where no row
    has another), of rows that share it the one with the least hash of its text. Documents without a word all stay; of
    rows that repeat an id and a text, one."""
    found = _with_classes(docs, THRESHOLD, TARGET, "doc_id", "text")
    some = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r")).select("r.doc_id", "r.text_key")
    kept = some.unionByName(found.where("component is null").select("doc_id", "text_key").distinct())
    id_, none, key = unused(docs, "id", "none", "key")
    names = {id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), none: F.col("doc_id").cast("long").isNull(), key: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    kept = kept.select(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("doc_id").isNull().alias(none), F.col("text_key").alias(key))
    return docs.withColumns(names).join(kept, [id_, none, key], "left_semi").dropDuplicates([id_, none, key]).select(*docs.columns)
