import random

from lumenframe.llm.tables import components


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200)] + [(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
