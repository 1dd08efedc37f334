"""Which tokens see which: predicate, classes, groups, tiles, and what history is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import C, col, whole_div
from ..tables import prefix
from .joins import matched

#: Kinds of tokens.
CONDITION, CLEAN, NOISY = 0, 1, 2


def visible(q: str, k: str, cross_view: bool = False, history: bool = True, joint: bool = False, single: bool = False, dropped: Column | None = None) -> Column:
    """Whether the token of prefix ``q`` sees that of prefix ``k``; both have kind, chunk, scope and active.

    Condition tokens are seen from their chunk on; clean ones see clean ones up to their chunk;
    noisy ones see earlier clean and equal noisy chunks. A token with a scope is seen in its
    scope only (unless views are crossed); a negative scope is seen by all.
    """
    f = lambda p, c: F.col(f"{p}_{c}")
    qc, kc = f(q, "chunk"), f(k, "chunk")
    seen = ~(F.lit(False) if dropped is None else dropped)
    is_ = lambda p, kind: f(p, "kind") == kind
    if single:
        base = (kc == qc) | ((kc < qc) & (seen | (kc < 0)))
        scope = F.lit(True) if cross_view else (f(k, "scope") < 0) | (f(q, "scope") == f(k, "scope"))
    else:
        up_to = F.lit(True) if joint else kc <= qc
        base = is_(k, CONDITION) & up_to
        if joint:
            base = base | (is_(q, CLEAN) & is_(k, CLEAN)) | (is_(q, NOISY) & (is_(k, CLEAN) | is_(k, NOISY)))
        else:
            base = base | (is_(q, CLEAN) & is_(k, CLEAN) & (up_to if history else kc == qc))
            if history:
                base = base | (is_(q, NOISY) & is_(k, CLEAN) & (kc < qc) & seen)
            base = base | (is_(q, NOISY) & is_(k, NOISY) & (kc == qc))
        scope = (f(q, "scope") >= 0) | (f(k, "scope") < 0) if cross_view else (f(k, "scope") < 0) | (f(q, "scope") == f(k, "scope"))
    return F.coalesce(base & scope, F.lit(False))


def classes(tokens: DataFrame, doc: list[str]) -> DataFrame:
    """Distinct (kind, chunk, scope) of active tokens per document, with their number."""
    return tokens.where("active").groupBy(*doc, "kind", "chunk", "scope").agg(F.count("*").alias("n"))


def class_pairs(tokens: DataFrame, doc: list[str], **how) -> DataFrame:
    """Pairs of classes of a document of which the first sees the second: the relation on classes, never on tokens."""
    hid = prefix(tokens)
    c = classes(tokens, doc)
    q = c.select(*doc, *[F.col(x).alias(f"q_{x}") for x in ("kind", "chunk", "scope", "n")])
    k = c.select(*[F.col(d).alias(f"{hid}d_{d}") for d in doc], *[F.col(x).alias(f"k_{x}") for x in ("kind", "chunk", "scope", "n")])
    same = visible("q", "k", **how)
    for d in doc:
        same = (F.col(d) == F.col(f"{hid}d_{d}")) & same
    return q.join(k, same).drop(*[f"{hid}d_{d}" for d in doc])


def visible_counts(tokens: DataFrame, doc: list[str], **how) -> DataFrame:
    """Per document: active query tokens and visible (query, key) pairs of tokens, summed over classes.

    An inactive token sees itself, so each adds one pair.
    """
    hid = prefix(tokens)
    pairs = class_pairs(tokens, doc, **how).groupBy(*doc).agg(F.sum(F.col("q_n") * F.col("k_n")).alias(f"{hid}p"))
    alone = tokens.groupBy(*doc).agg(F.sum(F.when(F.col("active"), 1).otherwise(0)).alias("tokens"), F.sum(F.when(F.col("active"), 0).otherwise(1)).alias(f"{hid}i"))
    return alone.join(pairs, doc, "left").select(*doc, "tokens", (F.coalesce(f"{hid}p", F.lit(0)) + F.col(f"{hid}i")).alias("pairs"))


def visibility_groups(tokens: DataFrame, doc: list[str], **how) -> DataFrame:
    """Queries that see the same keys, as groups: (doc, group, queries, keys). Works on classes; groups are numbered by their least class."""
    hid = prefix(tokens)
    key = F.concat_ws(":", "k_kind", "k_chunk", "k_scope")
    seen = class_pairs(tokens, doc, **how).groupBy(*doc, "q_kind", "q_chunk", "q_scope", "q_n").agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(key))), 256).alias("sees"), F.sum("k_n").alias("keys"))
    grouped = seen.groupBy(*doc, "sees").agg(F.min(F.struct("q_kind", "q_chunk", "q_scope")).alias(f"{hid}first"), F.sum("q_n").alias("queries"), F.first("keys").alias("keys"))
    w = Window.partitionBy(*doc).orderBy(f"{hid}first")
    return grouped.select(*doc, (F.row_number().over(w) - 1).cast("long").alias("group"), "queries", "keys")


def tile_counts(tokens: DataFrame, doc: list[str], position: str, tile: int, **how) -> DataFrame:
    """Tiles of the token-by-token relation: (q_tile, k_tile, visible, status), for tiles that are not empty.

    Tokens are counted per tile and class before classes meet, so tiles and classes are joined, not tokens.
    """
    hid = prefix(tokens)
    part = tokens.where("active").groupBy(*doc, F.floor(F.col(position) / tile).cast("long").alias("tile"), "kind", "chunk", "scope").agg(F.count("*").alias("n"))
    names = ("tile", "kind", "chunk", "scope", "n")
    q = part.select(*doc, *[F.col(x).alias(f"q_{x}") for x in names])
    k = part.select(*[F.col(d).alias(f"{hid}d_{d}") for d in doc], *[F.col(x).alias(f"k_{x}") for x in names])
    same = visible("q", "k", **how)
    for d in doc:
        same = (F.col(d) == F.col(f"{hid}d_{d}")) & same
    found = q.join(k, same).groupBy(*doc, "q_tile", "k_tile").agg(F.sum(F.col("q_n") * F.col("k_n")).alias("visible"))
    return found.withColumn("status", F.when(F.col("visible") == tile * tile, "full").otherwise("partial"))


def ordered_tiles(tiles: DataFrame, doc: list[str]) -> DataFrame:
    """Place of each key tile in its query tile's row: more visible first, then by position."""
    w = Window.partitionBy(*doc, "q_tile").orderBy(F.col("visible").desc(), "k_tile")
    return tiles.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def kept_history(df: DataFrame, by: list[str], chunk: str, sink: int, window: int, scope: str | None = None, sink_scope_zero: bool = False) -> DataFrame:
    """Rows of the first ``sink`` chunks of each group and of the last ``window``, by chunk number: chunks stay or go whole.

    The window counts back from the newest chunk number, whether or not the numbers between
    have rows. Without a window (0 or less) everything stays. With ``sink_scope_zero`` only
    scope 0 has a sink. The newest numbers are aggregated and joined back.
    """
    hid = prefix(df)
    if window <= 0:
        return df
    last = df.groupBy(*[F.col(c).alias(f"{hid}g_{c}") for c in by]).agg(F.max(chunk).alias(f"{hid}newest"))
    same = F.lit(True)
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"{hid}g_{c}")) & same
    early = F.col(chunk) < sink
    if sink_scope_zero:
        early = early & (F.col(scope) == 0)
    return df.join(last, same).where(early | (F.col(chunk) > F.col(f"{hid}newest") - window)).select(*df.columns)


def kept_history_by_time(df: DataFrame, by: list[str], chunk: str, scope: str, intervals: DataFrame, sink: float, window: float, sink_scope_zero: bool = False) -> DataFrame:
    """Rows whose chunk starts before ``sink``, or ends within ``window`` of the end of the newest chunk.

    ``intervals`` has (by, scope, chunk, start, end), chunks numbered from 0 in each scope. Time
    runs in each scope on its own; the newest chunk is that of the whole group. Chunk numbers
    outside a scope's list count as its nearest one. A row of a negative scope is shared: it
    stays if any scope keeps it. A null group is a group of its own.
    """
    hid = prefix(df, intervals)
    if window <= 0:
        return df
    newest = df.groupBy(*by).agg(F.max(chunk).alias(f"{hid}newest"))
    tops = intervals.groupBy(*by, "scope").agg(F.max("chunk").alias(f"{hid}top"))
    times = matched(matched(intervals, tops, [*by, "scope"]), newest, by)
    ends = times.where(F.col("chunk") == F.greatest(F.lit(0), F.least(f"{hid}newest", f"{hid}top"))).select(*by, "scope", F.col("end").alias(f"{hid}end"))
    spans = matched(times, ends, [*by, "scope"]).select(*[F.col(c).alias(f"{hid}g_{c}") for c in by], F.col("scope").alias(f"{hid}scope"), F.col("chunk").alias(f"{hid}chunk"), f"{hid}top", "start", "end", f"{hid}end")
    early = F.col("start") < sink
    if sink_scope_zero:
        early = early & (F.col(scope) == 0)
    hit = ((F.col(scope) == F.col(f"{hid}scope")) | (F.col(scope) < 0)) & (F.col(f"{hid}chunk") == F.greatest(F.lit(0), F.least(F.col(chunk), F.col(f"{hid}top")))) & (early | (F.col("end") > F.col(f"{hid}end") - window))
    for c in by:
        hit = F.col(c).eqNullSafe(F.col(f"{hid}g_{c}")) & hit
    return df.join(spans, hit, "left_semi")


def byte_budget(df: DataFrame, by: list[str], order: str, count: str, unit_bytes: C, budget: int) -> DataFrame:
    """Newest first, how many of each segment's tokens stay within the budget: ``kept`` of its last ones; the rest is ``moved``.

    A segment that no longer fits is split at a token. Only what is kept uses the budget up, so
    an older segment of smaller tokens may still find room; tokens of 0 bytes always do. What is left depends on every
    segment before, so the segments of a group (one sequence's cache) are folded in order.
    """
    hid = prefix(df)
    rows = df.withColumn(f"{hid}b", col(unit_bytes).cast("long"))
    segment = F.struct(order, F.col(count).cast("long").alias(f"{hid}n"), f"{hid}b", F.struct(*df.columns).alias(f"{hid}row"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept"))

    def take(s: Column, x: Column) -> Column:
        room = whole_div(F.greatest(F.lit(budget) - s["used"], F.lit(0).cast("long")), F.greatest(x[f"{hid}b"], F.lit(1).cast("long")))
        fits = F.when(x[f"{hid}b"] > 0, F.least(x[f"{hid}n"], room)).otherwise(x[f"{hid}n"])
        return F.struct((s["used"] + fits * x[f"{hid}b"]).alias("used"), F.concat(s["kept"], F.array(fits)).alias("kept"))

    each = rows.groupBy(*by).agg(F.sort_array(F.collect_list(segment), asc=False).alias(f"{hid}s")).select(F.explode(F.arrays_zip(f"{hid}s", F.aggregate(f"{hid}s", start, take, lambda s: s["kept"]).alias(f"{hid}k"))).alias(f"{hid}z"))
    return each.select(f"{hid}z.{hid}s.{hid}row.*", F.col(f"{hid}z.{hid}k").alias("kept"), (F.col(f"{hid}z.{hid}s.{hid}n") - F.col(f"{hid}z.{hid}k")).alias("moved"))
