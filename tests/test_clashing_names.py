"""Operators leave a caller's columns as they are, whatever their names."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import lumenframe
from lumenframe.operators import filters, joins, packing, partitioning, sampling, sets, stats, timebase, visibility
from lumenframe.sources import sinks


def helper_names():
    """All names that an operator gives to a column of its own."""
    out = set()
    for f in Path(lumenframe.__file__).parent.glob("[os]*/*.py"):
        text = f.read_text()
        out |= {f"_{m}" for m in re.findall(r"\{hid\}([a-z]+)", text)}
        for call in re.findall(r"unused\([^)]*\)", text):
            out |= {f"_{m}" for m in re.findall(r'"([a-z_]+)"', call)}
    return sorted(out)


@pytest.fixture(scope="module")
def rows(spark):
    names = helper_names()
    assert {"_id", "_size", "_n", "_top", "_part", "_before"} <= set(names)
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 5, i * 1.5) for i in range(12)], "k long, g string, v long, x double")
    return df.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("k").cast("string")) for c in names}), names


def kept(out, names):
    """Each row still has the values that it came with."""
    got = out.collect()
    assert got and set(names) <= set(out.columns)
    assert all(r[c] == f"{c}:{r.k}" for r in got for c in names)


OPERATORS = {
    "numbered": lambda d: sampling.numbered(d, ["k"], "num"),
    "running_total": lambda d: sampling.running_total(d, ["k"], "v"),
    "running_in_groups": lambda d: sampling.running_in_groups(d, ["g"], ["k"], F.col("v"), "so_far"),
    "place_in_groups": lambda d: sampling.place_in_groups(d, ["g"], ["k"]),
    "shape_shard": lambda d: sampling.shape_shard(d, ["g"], ["k"], 3),
    "strided_shard": lambda d: sampling.strided_shard(d, ["k"], 1, 3),
    "shuffled": lambda d: sampling.shuffled(d, ["g"], "k"),
    "mixture_weights": lambda d: sampling.mixture_weights(d, "v"),
    "choose_weighted": lambda d: sampling.choose_weighted(d, ["k"], d.select(F.col("k").alias("l"), F.col("v").alias("w")), "l", "w"),
    "first_fit": lambda d: sampling.first_fit(d, d.select(F.col("k").alias("o"), F.col("v").alias("t")), lambda t: t["t"] == F.col("v"), "o", ["t"]),
    "drawn_rows": lambda d: sampling.drawn_rows(d.drop("x"), d.select("g", F.col("k").alias("x")), ["g"], "v", "x"),
    "consecutive_distinct": lambda d: stats.consecutive_distinct(d, ["g"], ["k"], "v"),
    "scaled_to_one": lambda d: stats.scaled_to_one(d, ["g"], "x"),
    "unfolded": lambda d: stats.unfolded(d, ["g"], ["k"], "v", 5),
    "first_occurrences": lambda d: stats.first_occurrences(d, ["g", "v"], ["k"]),
    "running_peak": lambda d: stats.running_peak(d, ["g"], ["k"], "x"),
    "slice_rows": lambda d: filters.slice_rows(d, ["k"], 2, 9, 2),
    "with_presets": lambda d: joins.with_presets(d, "k", d.select(F.col("k").alias("p"), F.lit(1).alias("new")), "p", {"new": 0}),
    "indexed": lambda d: joins.indexed(d, d.select("g", "k", F.col("x").alias("y")), ["g"], "k", ["y"]),
    "matched": lambda d: joins.matched(d, d.select("k", F.lit(1).alias("y")), ["k"]),
    "asof_join": lambda d: joins.asof_join(d, d.select("g", "k", F.col("x").alias("y")), ["g"], "k", "k", ["y"]),
    "dense_levels": lambda d: packing.dense_levels(d, ["g"]),
    "even_picks": lambda d: timebase.even_picks(d, "v", 2),
    "segments": lambda d: partitioning.segments(d, ["k"], F.lit(30), F.lit(4), 2),
    "momentum_walk": lambda d: partitioning.momentum_walk(d, ["k"], F.lit(3), 12, F.lit(3)),
    "kept_history": lambda d: visibility.kept_history(d, ["g"], "v", 1, 2),
    "in_requested_order": lambda d: sets.in_requested_order(d, "k", [3, 1, 3]),
    "retained": lambda d: sinks.retained(d, "k", 3),
    "shard_numbers": lambda d: sinks.shard_numbers(d, ["k"], "v", 4),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_the_caller_stay(rows, name):
    df, names = rows
    kept(OPERATORS[name](df), names)


def test_a_table_that_is_too_large_for_one_array_is_refused(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_CHOICES", 5)
    d = spark.range(10).select(F.col("id").alias("k"), F.lit(1.0).alias("w"))
    with pytest.raises(Exception, match="too many choices"):
        sampling.choose_weighted(d, ["k"], d.withColumnRenamed("k", "l"), "l", "w").collect()


def test_decay_zero_is_the_last_value(spark):
    d = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 7.0), ("b", 1, 3.0)], "g string, t long, v double")
    assert sorted(tuple(r) for r in stats.moving_average(d, ["g"], ["t"], "v", 0.0).collect()) == [("a", 7.0, 2), ("b", 3.0, 1)]
    with pytest.raises(ValueError, match="decay"):
        stats.moving_average(d, ["g"], ["t"], "v", 1.5)


def test_fingerprints_of_values_that_read_alike_differ(spark):
    def of(*rows):
        d = spark.createDataFrame([(1, *r) for r in rows], "g long, a string, b string")
        return stats.fingerprint(d, ["g"], ["a", "b"]).first().fingerprint

    seen = [of(r) for r in (("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\x00", "x"), ("", "x"), ("-:", "x"), ("a", None), (None, "a"), ("1:a", ""), ("", "1:a"))]
    assert len(set(seen)) == len(seen)


def test_tokens_of_no_bytes_and_null_groups(spark):
    d = spark.createDataFrame([("s", 1, 10, 0), ("s", 2, 10, 3), (None, 1, 4, 0)], "g string, at long, n long, b long")
    got = {(r.g, r.at): (r.kept, r.moved) for r in visibility.byte_budget(d, ["g"], "at", "n", "b", 12).collect()}
    assert got == {("s", 2): (4, 6), ("s", 1): (10, 0), (None, 1): (4, 0)}
    chunks = spark.createDataFrame([(g, c, 0) for g in ("s", None) for c in range(5)], "g string, chunk long, scope long")
    times = spark.createDataFrame([(g, 0, c, float(c), c + 1.0) for g in ("s", None) for c in range(5)], "g string, scope long, chunk long, start double, end double")
    got = visibility.kept_history_by_time(chunks, ["g"], "chunk", "scope", times, 1.0, 1.5).collect()
    assert sorted((str(r.g), r.chunk) for r in got) == sorted((g, c) for g in ("s", "None") for c in (0, 3, 4))
