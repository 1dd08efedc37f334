import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import jaccard_join as J
from lumenframe.llm import queries


def shingles(t):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    near = [[i != j and bool(sets[i]) and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    seen, comp = {}, list(range(n))
    for i in range(n):
        if i in seen:
            continue
        stack = [i]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = i
                stack += [y for y in range(n) if near[x][y]]
    groups = defaultdict(list)
    for i in range(n):
        groups[seen[i]].append(i)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[k][0] for k in groups[seen[i]]]
        c = None if None in ids else min(ids)
        same = 1 if not sets[i] else sum(sets[i] == s for s in sets)
        out.append((d, c, sum(near[i]), same, len(sets[i])))
    return sorted(out, key=repr), comp


def test_odd_rows(odd_docs, no_docs, plain):
    got = sorted((tuple(r) for r in J.jaccard_join(odd_docs).collect()), key=repr)
    assert got == brute(plain)[0]
    assert J.jaccard_join(no_docs).count() == 0


def test_dense_group_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_NODES", 7)
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}_{k}" for k in range(50))) for i in range(20)]
    got = sorted((tuple(x) for x in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)[0]


def test_whole_table_equals_sql(spark, data):
    from duck import same

    same(queries.op6_jaccard_join(spark, data), queries.ORACLES["op6_jaccard_join"], data)


def test_depth_is_shortened_to_the_target():
    d = J.prefix_depth()
    assert J.recall(d, J.TREES, J.THRESHOLD) >= J.TARGET > J.recall(d + 1, J.TREES, J.THRESHOLD)
    assert J.prefix_depth(0.5) > d


def test_recall_at_the_threshold():
    r = np.random.default_rng(1)
    hit = 0
    for _ in range(200):
        common, a, b = (np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (160, 20, 20))
        sets = [np.sort(np.concatenate([common, x])) for x in (a, b)]
        k = J.paths(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]), J.prefix_depth())
        hit += bool((k[0] == k[1]).all(axis=1).any())
    assert hit == 200


@pytest.mark.parametrize("many", [False, True])
def test_links_by_matrix_and_by_pair_agree(many):
    r = np.random.default_rng(2)
    base = np.unique(r.integers(0, 1 << 60, 300, dtype=np.uint64))
    sets = [np.sort(np.unique(np.concatenate([r.choice(base, 280, replace=False), r.integers(0, 1 << 60, 5, dtype=np.uint64)]))) for _ in range(40 if many else 5)]
    got = J.links(sets, sets, J.Fraction("0.8"))
    want = [[len(set(a.tolist()) & set(b.tolist())) * 10 >= 8 * len(set(a.tolist()) | set(b.tolist())) for b in sets] for a in sets]
    assert (got == np.array(want)).all()


def test_one_row_of_each_class_stays(spark, odd_docs, no_docs):
    kept = J.representatives(odd_docs)
    assert kept.columns == odd_docs.columns and J.representatives(no_docs).count() == 0
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    ids = [i for i, _ in rows]
    assert len(rows) == len(set(rows)) and ids.count(1) == 1 and ids.count(9) == 2 and not {2, 6} & set(ids)
    assert ids.count(None) == 2  # an empty text, and one that no other is like


def test_representatives_with_clashing_names(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "a"), (1, words + " z", "b"), (1, "other words under the same id", "c"), (2, words, "d"), (2, words, "e"), (None, words, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _class_id string")
    docs = docs.withColumns({c: F.col("_class_id") for c in ("_id", "_none", "_key", "__id", "component", "text_key", "routes", "prefix")})
    kept = J.representatives(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == [1, 1] and "c" in [r._class_id for r in got] and all(r._id == r._class_id for r in got)


def test_words_that_differ_are_never_taken_for_equal(spark):
    from test_sentencepiece import thue_morse

    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        for j, w in enumerate(thue_morse(n)):
            rows.append((10 * k + j, f"one two three four {w} six"))
    got = sorted((tuple(x) for x in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)[0] and all(r[2] == 0 for r in got)


def test_nodes_end_at_different_depths(spark, monkeypatch):
    """Few matches: prefixes go on to be shortened. Many: they stop where the target recall is reached."""
    r = random.Random(8)
    depth = J.prefix_depth()
    stem, chars = b"\x00" + bytes(2 * J.SHORTEST), [bytes([0, k]) for k in range(60)]
    # one tree; a crowd that shares all but the last value, and a pair that shares SHORTEST values only
    crowd = [(b"c%02d" % k, [stem + b"\x07\x07" * (depth - J.SHORTEST - 1) + chars[k % 2]]) for k in range(40)]
    pair = [(b"p%d" % k, [b"\x00" + b"\x09" * (2 * J.SHORTEST) + bytes([k]) * (2 * (depth - J.SHORTEST))]) for k in range(2)]
    got = J.candidate_groups(spark.createDataFrame(crowd + pair, "node binary, paths array<binary>"), depth, few=16).collect()
    ends = {}
    for g in got:
        ends.setdefault(bytes(g.node), set()).add((len(g.prefix) - 1) // 2)
    assert all(ends[n] == {depth} for n, _ in crowd) and all(ends[n] == {J.SHORTEST} for n, _ in pair)
    assert {bytes(g.hub) for g in got if g.node.startswith(b"p")} == {b"p0"}


def test_groups_of_different_homes_meet(spark, monkeypatch):
    """Chains of near copies: neighbours are alike, ends are not; small blocks, so that links cross homes and blocks."""
    monkeypatch.setattr(J, "BLOCK_NODES", 3)
    r, rows = random.Random(9), []
    for c in range(6):
        w = [f"c{c}_{i}" for i in range(80)]
        for i in range(25):
            rows.append((100 * c + i, " ".join(w)))
            w = list(w)
            for _ in range(r.randint(1, 2)):
                w[r.randrange(80)] = f"n{r.randrange(10**6)}"
    got = sorted((tuple(x) for x in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(rows)[0]


@pytest.mark.parametrize("n", [100, 400])
def test_a_crowded_prefix_of_nodes_with_closer_copies_has_few_routes(spark, n):
    """N nodes of one prefix, each with a closer copy whose name is less: routes grow with N, not with its square."""
    page = [(b"x%04d" % i, b"page", b"x0000", n) for i in range(n)]
    close = [(node, b"close%04d" % i, b"a%04d" % i, 2) for i in range(n) for node in (b"x%04d" % i, b"a%04d" % i)]
    groups = spark.createDataFrame(page + close, "node binary, prefix binary, hub binary, members long")
    names = sorted({g[0] for g in page + close})
    nodes = spark.createDataFrame([(x, i, 0, 1, 50) for i, x in enumerate(names)], "node binary, doc_id long, text_key long, size long, n long")
    routes = J._routes(groups, nodes).select("node", F.explode("routes").alias("r")).select("node", "r.*").collect()
    assert len(routes) <= 5 * n
    met = {}
    for r in routes:
        met.setdefault((bytes(r.left_home), r.left_block, bytes(r.right_home), r.right_block), set()).add(bytes(r.node))
    assert all(any({b"x%04d" % i, b"a%04d" % i} <= m for m in met.values()) for i in range(n))
    assert any({x for x, *_ in page} <= m for m in met.values())


def test_a_larger_table_equals_sql(spark):
    from duck import same

    path = "/root/testdata/sf0.01"
    same(queries.op6_jaccard_join(spark, path), queries.ORACLES["op6_jaccard_join"], path)
