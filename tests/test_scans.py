"""Ordered scans in parts of a group, and files of any size."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import joins, scans, stats
from lumenframe.sources import archives as A


def groups(seed=0, n=400):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None, "hot", "hot", "hot"]), i, r.choice([None, *range(9)])) for i in r.sample(range(10 * n), n)]


def by_group(rows):
    out = {}
    for g, t, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(g, []).append((t, v))
    return out


@pytest.mark.parametrize("kind", sorted(scans.KINDS))
@pytest.mark.parametrize("parts", [1, 7])
def test_scans_are_those_of_a_loop(spark, kind, parts):
    rows, want = groups(), {}
    for own in by_group(rows).values():
        last = top = None
        before = "none"
        for t, v in own:
            last = v if v is not None else last
            top = v if top is None or (v is not None and v > top) else top
            want[t] = {"last": last, "greatest": top, "previous": before}[kind]
            before = v
    out = scans.scanned(spark.createDataFrame(rows, "g string, t long, v long"), ["g"], ["t"], F.col("v"), "s", kind, parts).collect()
    got = {r.t: (r.s if kind != "previous" else "none" if r.s is None else r.s.value) for r in out}
    assert got == want and len(out) == len(rows)


def test_a_hot_group_has_many_tasks(spark):
    """A third of the rows in one group: its rows lie in several parts, none of which has more than a share."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("g"), "id", (F.col("id") % 100).alias("v"))
    out = stats.running_peak(rows, ["g"], ["id"], "v")
    assert out.where("g = 0").agg(F.min(F.struct("id", "peak"))).first()[0].peak == 0 and out.where("g = 0 and id >= 300").agg(F.min("peak")).first()[0] == 99
    from lumenframe.operators.sampling import _dealt

    dealt, _, part = _dealt(rows, ["g", "id"], 12)
    sizes = [r["count"] for r in dealt.where("g = 0").groupBy(part).count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 2500


def test_asof_of_a_hot_key_and_null_keys(spark):
    r = random.Random(2)
    left = [(g, t) for g in ("hot", None, "x") for t in r.sample(range(1000), 80)]
    right = [(g, t, f"{g}{t}") for g in ("hot", "hot2", None) for t in r.sample(range(1000), 60)]
    l, rt = spark.createDataFrame(left, "g string, t long"), spark.createDataFrame(right, "g string, t long, v string")  # noqa: E741
    for strict in (False, True):
        got = {(x.g, x.t): x.v for x in joins.asof_join(l, rt, ["g"], "t", "t", ["v"], strict).collect()}
        for g, t in left:
            before = [(u, v) for h, u, v in right if h == g and (u < t or (u == t and not strict))]
            assert got[g, t] == (max(before)[1] if before else None)


def test_unfolded_is_that_of_a_loop(spark):
    r = random.Random(4)
    rows = [(g, t, r.randrange(12)) for g in ("a", None) for t in range(150)]
    want = {}
    for g in ("a", None):
        turns, before = 0, None
        for t, v in [(t, v) for h, t, v in rows if h == g]:
            turns += before is not None and abs(v - before) > 6
            want[g, t] = 12 - v if turns % 2 else v
            before = v
    got = stats.unfolded(spark.createDataFrame(rows, "g string, t long, v long"), ["g"], ["t"], "v", 12)
    assert {(x.g, x.t): x.unfolded for x in got.collect()} == want


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    p, r = tmp_path_factory.mktemp("files"), random.Random(6)
    (p / "sub").mkdir()
    for name, n in (("empty", 0), ("one", 1), ("exact", 4096), ("over", 4097), ("sub/large", 50_000)):
        (p / name).write_bytes(r.randbytes(n))
    return str(p)


def test_trees_of_digests(spark, files):
    ranges = A.range_digests(A.files_below(spark, files), 4096)
    got = {r.path[len(files) + 1 :]: r for r in A.file_trees(ranges).collect()}
    assert set(got) == {"empty", "one", "exact", "over", "sub/large"}
    for name, r in got.items():
        data = open(f"{files}/{name}", "rb").read()
        leaves = [hashlib.sha256(data[i : i + 4096]).hexdigest() for i in range(0, max(1, len(data)), 4096)]
        assert (r.bytes, r.ranges, r.root) == (len(data), len(leaves), hashlib.sha256("".join(leaves).encode()).hexdigest())


def test_archives_give_files_back(spark, files, tmp_path):
    folder = str(tmp_path / "archive")
    index = A.write_archive(A.files_below(spark, files), folder, 4096).collect()
    assert len(index) == 5 and len({r.part for r in index}) > 1
    for r in index:
        data = open(r.path, "rb").read()
        assert A.archived(spark, folder, r.path) == data and hashlib.sha256(data).hexdigest() == r.sha256
    assert not [f for f in os.listdir(folder) if f.startswith("_part")]
    with pytest.raises(KeyError):
        A.archived(spark, folder, "none")


def test_a_sparse_file_above_2_gb(spark, tmp_path):
    n = (2 << 30) + 12_345
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(n)
    ranges = A.range_digests(A.files_below(spark, str(tmp_path)), 256 << 20)
    r = A.file_trees(ranges).first()
    h, whole = hashlib.sha256(), bytes(1 << 20)
    for _ in range(256):
        h.update(whole)
    leaves = [h.hexdigest()] * 8 + [hashlib.sha256(bytes(12_345)).hexdigest()]
    assert (r.bytes, r.ranges, r.root) == (n, 9, hashlib.sha256("".join(leaves).encode()).hexdigest())
