"""Aggregations of losses, metrics, exposure and sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import C, col, gamma_exponent, psnr
from ..tables import prefix, unused
from .sampling import place_in_groups, running_in_groups
from .scans import scanned


def exact(x: C, scale: int = 9) -> Column:
    """As a decimal: sums of it do not depend on the order of rows."""
    return col(x).cast(f"decimal(28,{scale})")


def weighted_mean(value: C, weight: C, floor: float | None = 1.0) -> Column:
    """Sum of value * weight over the sum of weights, the latter at least ``floor``."""
    top, total = F.sum(exact(col(value) * col(weight))).cast("double"), F.sum(exact(weight)).cast("double")
    return top / (F.nullif(total, F.lit(0.0)) if floor is None else F.greatest(total, F.lit(floor)))


def supervised(value: C, mask: C) -> tuple[Column, Column, Column]:
    """Mean, least and greatest value over the supervised rows."""
    v = F.when(col(mask), col(value))
    return F.sum(exact(v)).cast("double") / F.count(v), F.min(v), F.max(v)


def block_histogram(df: DataFrame, by: list[str], block: str) -> DataFrame:
    """Blocks of each group with their least, greatest and total size."""
    sizes = df.groupBy(*by, block).agg(F.count("*").alias("size"))
    return sizes.groupBy(*by).agg(F.count("*").alias("blocks"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("rows"))


def replica_reduce(df: DataFrame, step: list[str], worst: list[str] = (), mean: list[str] = (), covered: list[str] = (), any_of: list[str] = (), all_of: list[str] = ()) -> DataFrame:
    """Metrics of replicas by step: greatest, mean, mean only if every replica has a value, or, and."""
    aggs = [F.max(c).alias(f"max_{c}") for c in worst] + [(F.sum(exact(c)).cast("double") / F.count(c)).alias(f"avg_{c}") for c in mean]
    aggs += [F.when(F.count(c) == F.count("*"), F.sum(exact(c)).cast("double") / F.count(c)).alias(f"all_{c}") for c in covered]
    aggs += [F.bool_or(c).alias(f"any_{c}") for c in any_of] + [F.bool_and(c).alias(f"every_{c}") for c in all_of]
    return df.groupBy(*step).agg(*aggs)


def exact_percentiles(df: DataFrame, by: list[str], value: C, shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of each group under the given names, exact; nulls do not count.

    Equal values are counted first, the counts are summed up in order in parts of a group, and
    each percentile picks the two values around its rank: no task holds the values of a group.
    """
    hid = prefix(df)
    counts = df.where(col(value).isNotNull()).groupBy(*by, col(value).cast("double").alias(f"{hid}v")).agg(F.count("*").alias(f"{hid}c"))
    total = counts.groupBy(*[F.col(c).alias(f"{hid}g_{c}") for c in by]).agg(F.sum(f"{hid}c").alias(f"{hid}n"))
    same = F.lit(True)
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"{hid}g_{c}")) & same
    placed = running_in_groups(counts, by, [f"{hid}v"], F.col(f"{hid}c"), f"{hid}before").join(total, same)
    rank = {n: (F.col(f"{hid}n") - 1) * F.lit(share) for n, share in shares.items()}
    at = lambda r: F.max(F.when((F.col(f"{hid}before") <= r) & (r < F.col(f"{hid}before") + F.col(f"{hid}c")), F.col(f"{hid}v")))
    picked = placed.groupBy(*by).agg(F.max(f"{hid}n").alias(f"{hid}n"), *[at(F.floor(r)).alias(f"{hid}lo_{n}") for n, r in rank.items()], *[at(F.ceil(r)).alias(f"{hid}hi_{n}") for n, r in rank.items()])
    between = {n: F.col(f"{hid}lo_{n}") + (F.col(f"{hid}hi_{n}") - F.col(f"{hid}lo_{n}")) * (r - F.floor(r)) for n, r in rank.items()}
    return picked.select(*by, *[c.alias(n) for n, c in between.items()])


def exposure_gamma(df: DataFrame, by: list[str], value: C, band: dict[str, float] | None = None) -> DataFrame:
    """Median, 95th percentile (interpolated) and the exponent that corrects the exposure of each group."""
    return exact_percentiles(df, by, value, {"median": 0.5, "p95": 0.95}).withColumn("gamma", gamma_exponent("median", "p95", band))


def signal_metrics(df: DataFrame, by: list[str], a: C, b: C) -> DataFrame:
    """Mean squared error, PSNR and mean absolute error of two signals in [0, 1]."""
    d = col(a) - col(b)
    out = df.groupBy(*by).agg((F.sum(exact(d * d, 12)).cast("double") / F.count(d)).alias("mse"), (F.sum(exact(F.abs(d), 12)).cast("double") / F.count(d)).alias("mae"))
    return out.withColumn("psnr", psnr("mse"))


def improvement(df: DataFrame, by: list[str], step: str, value: str, needed: float) -> DataFrame:
    """First and last value by step, the relative improvement, and whether it reaches what is needed."""
    out = df.groupBy(*by).agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"))
    gain = (F.col("first") - F.col("last")) / F.nullif(F.col("first"), F.lit(0.0))
    return out.withColumn("gain", gain).withColumn("passed", F.coalesce(gain >= needed, F.lit(False)))


def evaluation_grid(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Means over a grid of two keys, with the totals of the first key and of all."""
    return df.rollup(a, b).agg((F.sum(exact(value)).cast("double") / F.count(value)).alias("mean"), F.count("*").alias("n"))


def first_occurrences(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, in the given order; min over rows, so that copies shrink before they move."""
    hid = prefix(df)
    row = F.min(F.struct(*order, *[c for c in df.columns if c not in order])).alias(f"{hid}r")
    return df.groupBy(*[F.col(k).alias(f"{hid}k_{k}") for k in key]).agg(row).select(*[F.col(f"{hid}r.{c}").alias(c) for c in df.columns])


def consecutive_distinct(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before; the first row of a group stays."""
    (p,) = unused(df, "p")
    rows = scanned(df, by, order, F.col(value), p, "previous")
    return rows.where(F.col(p).isNull() | ~F.col(f"{p}.value").eqNullSafe(F.col(value))).drop(p)


def scaled_to_one(df: DataFrame, by: list[str], value: str, name: str = "scaled") -> DataFrame:
    """Values divided by the greatest absolute value of their group; unchanged if that is 0."""
    most, (top,) = F.max(F.abs(F.col(value))).over(Window.partitionBy(*by)), unused(df, "top")
    return df.withColumn(top, most).withColumn(name, F.when(F.col(top) > 0, F.col(value) / F.col(top)).otherwise(F.col(value))).drop(top)


def spans(df: DataFrame, by: list[str], frame: str) -> DataFrame:
    return df.groupBy(*by).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"))


def cache_statistics(df: DataFrame, by: list[str], key: str, hit: C) -> DataFrame:
    """Requests, distinct keys, misses, and distinct keys that had to be made."""
    h = F.coalesce(col(hit), F.lit(False))
    return df.groupBy(*by).agg(F.count("*").alias("requests"), F.count_distinct(key).alias("keys"), F.count_if(~h).alias("misses"), F.count_distinct(F.when(~h, F.col(key))).alias("made"))


def running_peak(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "peak") -> DataFrame:
    """The greatest value of a group so far, in parts of the group."""
    return scanned(df, by, order, F.col(value), name, "greatest")


def rate_groups(df: DataFrame, rate: str, member: str, block: int = 10_000) -> DataFrame:
    """Members by learning rate, in order, with their number; a row for each range of ``block`` ids, so that no row holds a large group."""
    hid = prefix(df)
    ids = F.col(member) - F.pmod(F.col(member), F.lit(block))
    return df.groupBy(rate, ids.alias(f"{hid}b")).agg(F.array_sort(F.collect_list(member)).alias("members"), F.count("*").alias("n")).drop(f"{hid}b")


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, decay: float, warm_up: bool = False, name: str = "ema") -> DataFrame:
    """Exponential moving average at the end of each group: d * average + (1 - d) * value, from the first value on.

    With warm-up the decay at update n is min(d, (1 + n) / (10 + n)). A value's weight is what
    the decays behind it leave of it, so the average is a sum of weighted values: rows are
    numbered, and the logarithms of the decays summed, in parts of a group, and no task holds
    a whole group.
    """
    hid = prefix(df)
    if not 0 <= decay <= 1:
        raise ValueError("a decay lies from 0 to 1")
    if decay == 0:  # nothing is left of the values before the last
        last = F.max_by(F.col(value).cast("double"), F.struct(*order))
        return df.groupBy(*by).agg(last.alias(name), F.count("*").alias("n"))
    rows = place_in_groups(df.select(*by, *order, F.col(value).cast("double").alias(f"{hid}v")), by, order, f"{hid}i")
    d = F.least(F.lit(decay), (F.col(f"{hid}i") + 1) / (F.col(f"{hid}i") + 10)) if warm_up else F.lit(decay)
    log_d = F.when(F.col(f"{hid}i") > 0, F.log(d)).otherwise(0.0)
    if warm_up:
        rows = running_in_groups(rows, by, order, log_d, f"{hid}l").withColumn(f"{hid}l", F.col(f"{hid}l") + log_d)
    else:
        rows = rows.withColumn(f"{hid}l", F.col(f"{hid}i") * F.log(F.lit(decay)))
    last = rows.groupBy(*[F.col(c).alias(f"{hid}g_{c}") for c in by]).agg(F.count("*").alias("n"), F.min(f"{hid}l").alias(f"{hid}end"))
    same = F.lit(True)
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"{hid}g_{c}")) & same
    share = F.when(F.col(f"{hid}i") > 0, 1 - d).otherwise(1.0) * F.exp(F.col(f"{hid}end") - F.col(f"{hid}l"))
    return rows.join(last, same).groupBy(*by, "n").agg(F.sum(share * F.col(f"{hid}v")).alias(name)).select(*by, name, "n")


def warm_up(step: C, steps: int) -> Column:
    """Factor of the learning rate at a step: a ramp to 1."""
    return F.least(F.lit(1.0), (col(step) + 1) / F.lit(float(steps)))


def unfolded(df: DataFrame, by: list[str], order: list[str], value: str, base: int, name: str = "unfolded") -> DataFrame:
    """A ring position made continuous: each jump of more than half the ring turns the direction, and turned parts are reflected."""
    p, j, t = unused(df, "p", "j", "t")
    rows = scanned(df, by, order, F.col(value), p, "previous")
    jump = F.coalesce(F.abs(F.col(value) - F.col(f"{p}.value")) > base / 2, F.lit(False)).cast("long")
    rows = running_in_groups(rows.withColumn(j, jump).drop(p), by, order, F.col(j), t)
    turned = (F.col(t) + F.col(j)) % 2
    return rows.withColumn(name, F.when(turned == 1, base - F.col(value)).otherwise(F.col(value))).drop(j, t)


def fingerprint(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """One digest of all rows of each group, whatever their order: (by, fingerprint, n).

    Digests of rows are sorted and digested in ranges by their first four hex digits, and those
    of a group's ranges, in order, once more: a row holds a 65,536th of a group.
    """
    hid = prefix(df)
    text = [F.col(c).cast("string") for c in columns]  # each value with its length in front, so that no two rows read alike; a null has none
    row = F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-:")) for t in text]).cast("binary"), 256)
    parts = df.select(*by, row.alias(f"{hid}r")).groupBy(*by, F.substring(f"{hid}r", 1, 4).alias(f"{hid}k")).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(f"{hid}r"))), 256).alias(f"{hid}d"), F.count("*").alias(f"{hid}n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(f"{hid}k", f"{hid}d"))), lambda x: x[f"{hid}d"])
    return parts.groupBy(*by).agg(F.sha2(F.concat_ws(",", ordered), 256).alias("fingerprint"), F.sum(f"{hid}n").alias("n"))
