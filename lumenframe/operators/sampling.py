"""Deterministic sampling, shuffling, sharding and mixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import C, col, integer_draw, unit
from ..tables import saved, unused


def numbered(df: DataFrame, order: list[str], name: str = "n", parts: int = 0) -> DataFrame:
    """Rows numbered from 0 in a total order, without bringing them to one task.

    Rows are range-partitioned, sorted and numbered inside their partition; that table is
    written once, so that partition sizes (one row each) and rows agree on who is where.
    """
    names, size, start = df.columns, *unused(df, "size", "before")
    rows, row, part = _dealt(df, order, parts)
    sizes = rows.groupBy(part).agg(F.count("*").alias(size)).select(part, _sum_before(size, part).alias(start))
    place = F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(sizes), part).select(*[c for c in names if c != name], (place + F.col(start)).alias(name))


def running_total(df: DataFrame, order: list[str], size: str, name: str = "before", parts: int = 0) -> DataFrame:
    """Exclusive running sum of sizes over the whole table in a total order, dealt as in ``numbered``; null sizes add nothing."""
    names, whole, start, own = df.columns, *unused(df, "size", "before", "own")
    rows, row, part = _dealt(df, order, parts)
    sizes = rows.groupBy(part).agg(F.sum(size).alias(whole)).select(part, _sum_before(whole, part).alias(start))
    inside = Window.partitionBy(part).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(own, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return rows.join(F.broadcast(sizes), part).select(*[c for c in names if c != name], (F.col(own) + F.col(start)).cast("long").alias(name))


def _sum_before(size: str, part: str) -> Column:
    """The sizes of all parts before one; a row a part, so one task has few rows."""
    return F.coalesce(F.sum(size).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _dealt(df: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, str, str]:
    """Range-partitioned, sorted rows, and the names of the columns with a row's number and its part's, which ``df`` does not have."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, part = unused(df, "id", "part")
    rows = saved(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id()))
    return rows.withColumn(part, F.shiftright(row, 33)), row, part


def strided_shard(df: DataFrame, order: list[str], shard: int, shards: int) -> DataFrame:
    """Every ``shards``-th row from row ``shard`` in the total order."""
    (n,) = unused(df, "n")
    return numbered(df, order, n).where(F.pmod(F.col(n) - shard, F.lit(shards)) == 0).drop(n)


def running_in_groups(df: DataFrame, by: list[str], order: list[str], size: Column, name: str, parts: int = 0) -> DataFrame:
    """Exclusive running sum of ``size`` inside each group, without bringing a group to one task.

    Rows are range-partitioned by group and order, so a large group has many parts; sums of a
    group's parts (a row each) are summed up and joined to the sums inside the parts. A column of
    the result's name is replaced; no other column of the table is touched.
    """
    names = df.columns
    own_size, own, total, start, other, *groups = unused(df, "size", "own", "sum", "before", "p", *[f"g_{c}" for c in by])
    rows, row, part = _dealt(df.withColumn(own_size, size), [*by, *order], parts)
    inside = Window.partitionBy(*by, part).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    rows_before = rows.withColumn(own, F.coalesce(F.sum(own_size).over(inside), F.lit(0)))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, part).agg(F.sum(own_size).alias(total)).withColumn(start, F.coalesce(F.sum(total).over(before), F.lit(0)))
    side = sums.where(F.col(start) != 0).select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col(part).alias(other), start)  # most groups lie in one part
    same = F.col(part) == F.col(other)
    for c, g in zip(by, groups, strict=True):
        same = F.col(c).eqNullSafe(F.col(g)) & same
    return rows_before.join(side, same, "left").select(*[c for c in names if c != name], (F.col(own) + F.coalesce(start, F.lit(0))).alias(name))


def place_in_groups(df: DataFrame, by: list[str], order: list[str], name: str = "place", parts: int = 0) -> DataFrame:
    """Number of each row in its group, from 0, in the order; dealt as in ``running_in_groups``."""
    return running_in_groups(df, by, order, F.lit(1).cast("long"), name, parts)


def shape_shard(df: DataFrame, shape: list[str], order: list[str], shards: int, name: str = "shard") -> DataFrame:
    """Shard of each row, dealt in turn inside each shape, so that shapes stay balanced over shards."""
    return place_in_groups(df, shape, order, name).withColumn(name, F.pmod(F.col(name), F.lit(shards)).cast("long"))


def effective_samples(df: DataFrame, source: str, frames: C, fps: C, model_fps: float, latents: int) -> DataFrame:
    """Windows of ``latents`` that each source yields, divided by eight; at least 1 for a source with rows.

    The clips' seconds are summed as decimals, so the sum does not depend on the order of rows.
    """
    span = 4 * latents - 3
    seconds = (F.coalesce(col(frames), F.lit(0)) / F.coalesce(F.nullif(col(fps), F.lit(0)), F.lit(model_fps))).cast("decimal(28,9)")
    total = F.sum(seconds).cast("double") * model_fps
    return df.groupBy(source).agg(F.greatest(F.lit(1), F.floor(total / span / 8)).cast("long").alias("eff"), F.count("*").alias("n"))


def mixture_weights(sources: DataFrame, eff: str = "eff", power: C = 0.8) -> DataFrame:
    """Sampling weight of each source: eff ** power, normalised; 0 where eff is 0, and everywhere if all are.

    One row per source; a mixture has tens of them.
    """
    p = F.lit(power) if isinstance(power, float) else col(power)
    raw = F.when(F.col(eff) > 0, F.pow(F.col(eff).cast("double"), p)).otherwise(F.lit(0.0))
    (w,) = unused(sources, "w")
    total = F.sum(w).over(Window.partitionBy())
    return sources.withColumn(w, raw).withColumn("weight", F.coalesce(F.col(w) / F.nullif(total, F.lit(0.0)), F.lit(0.0))).drop(w)


def choose_weighted(df: DataFrame, key: list[str], choices: DataFrame, label: str, weight: str, salt: str = "", name: str = "choice") -> DataFrame:
    """One label per row, drawn by key with the labels' weights.

    The labels, a small dimension table, become one array of cumulative bounds in label
    order, so a row's choice is a lookup and nothing is joined row by row.
    """
    w = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    all_bounds, draw, at = unused(df, "bounds", "u", "x")
    bounds = choices.where(F.col(weight) > 0).select(F.col(label).alias("l"), F.sum(weight).over(w).alias("hi"))
    table = bounded(bounds, MOST_CHOICES, "choices").agg(F.array_sort(F.collect_list(F.struct("hi", "l"))).alias(all_bounds))
    size = F.size(all_bounds)
    bound = lambda i: F.element_at(all_bounds, i)

    def halve(s: Column, _: Column) -> Column:  # the first bound above the draw lies from lo to hi
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        above = bound(mid)["hi"] > F.col(at)
        return F.struct(F.when(above, s["lo"]).otherwise(F.least(mid + 1, s["hi"])).alias("lo"), F.when(above, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(size)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(1).alias("lo"), size.alias("hi")), halve, lambda s: s["lo"])
    rows = df.withColumn(draw, unit(*key, salt=salt)).join(F.broadcast(table))
    out = rows.withColumn(at, F.when(size > 0, F.col(draw) * bound(-1)["hi"]))
    return out.withColumn(name, F.when(size > 0, bound(found)["l"])).drop(draw, at, all_bounds)


#: The most rows of a table that becomes one array and is broadcast: choices of a draw, tiers of a recipe.
MOST_CHOICES = 100_000


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """The table, if it has at most ``most`` rows; an error where it is run if it has more."""
    n, stop = unused(df, "n", "stop")
    few = F.when(F.col(n) > most, F.raise_error(F.concat(F.lit(f"too many {what} for one array: "), F.col(n).cast("string")))).otherwise(F.lit(True))
    return df.withColumn(n, F.count("*").over(Window.partitionBy())).withColumn(stop, few.cast("boolean")).where(stop).select(*df.columns)


def choose_shape(key: list[C], shapes: list[tuple[int, int]], cameras: C, salt: str = "shape_pool") -> Column:
    """A (views, latents) shape drawn by key from those that the row's cameras allow; null if none does."""
    pool = F.array(*[F.struct(F.lit(v).cast("long").alias("views"), F.lit(g).cast("long").alias("latents")) for v, g in shapes])
    fits = F.filter(pool, lambda s: s["views"] <= col(cameras))
    return F.when(F.size(fits) > 0, F.element_at(fits, (integer_draw(F.size(fits), *key, salt=salt) + 1).cast("int")))


def shuffled(df: DataFrame, group: list[str], key: str, salt: str = "", name: str = "place") -> DataFrame:
    """Place of each row in a shuffle of its group: the order of a digest of salt and key, then of the key."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")))
    (d,) = unused(df, "d")
    return place_in_groups(df.withColumn(d, digest), group, [d, key], name).drop(d)


def replacement_sample(spark, rows: int, draws: int, seed: str, block: int = 32) -> DataFrame:
    """Draws with replacement, in blocks as the cursor of a resumable sampler counts them: (draw, block, pos, row)."""
    out = spark.range(draws).select(F.col("id").alias("draw"))
    return out.select("draw", F.floor(F.col("draw") / block).cast("long").alias("block"), F.pmod("draw", F.lit(block)).alias("pos"), integer_draw(F.lit(rows), "draw", salt=seed).alias("row"))


def epoch_of(draw: C, rows: int) -> tuple[Column, Column]:
    """(epoch, row) of a running index over a finite source."""
    return F.floor(col(draw) / rows).cast("long"), F.pmod(col(draw), F.lit(rows))


def window_start(n: C, length: C, *key: C, salt: str = "start") -> Column:
    """First frame of a window placed by key; null if it does not fit."""
    room = col(n) - col(length)
    return F.when(room >= 0, F.floor(unit(*key, salt=salt) * (room + 1)).cast("long"))


def first_fit(df: DataFrame, tiers: DataFrame, fits: Callable[[Column], Column], order: str, columns: list[str]) -> DataFrame:
    """Add the columns of the first tier, in order, that fits each row; null if none does.

    Tiers are a priority list of a recipe (a handful of rows): they become one array that is
    looked through in place, so nothing is exploded or shuffled. ``fits`` gets a tier.
    """
    every, first = unused(df, "tiers", "tier")
    table = bounded(tiers, MOST_CHOICES, "tiers").agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in tiers.columns if c != order]))).alias(every))
    found = F.get(F.filter(every, lambda t: F.coalesce(fits(t), F.lit(False))), F.lit(0))
    return df.join(F.broadcast(table)).withColumn(first, found).select(*df.columns, *[F.col(f"{first}.{c}").alias(c) for c in columns])


def text_dropped(text: C, rate: float, *key: C, salt: str = "text") -> Column:
    """The text, or null with the given rate, by key."""
    return F.when(unit(*key, salt=salt) >= rate, col(text))


def noise_level(shift: float, *key: C, salt: str = "sigma") -> Column:
    """A shifted uniform noise level by key."""
    u = unit(*key, salt=salt)
    return shift * u / (1.0 + (shift - 1.0) * u)


def condition_length(count: C, probability: float, *key: C) -> Column:
    """How many leading units condition a sample: none with 1 - probability, else 1 to count - 1."""
    return F.when((col(count) > 1) & (unit(*key, salt="condition") < probability), 1 + integer_draw(col(count) - 1, *key, salt="length")).otherwise(F.lit(0).cast("long"))


def dropout_pairs(df: DataFrame, key: list[str], blocks: str, rate: float) -> DataFrame:
    """For each row one (i, j, dropped) per ordered pair of its blocks, j < i: which history a block does not see."""
    pair = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))).where("i > 0")
    pair = pair.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("i") - 1)))
    return pair.withColumn("dropped", unit(*key, "i", "j", salt="history") < rate)


def redirected_shape(views: C, latents: C, key: list[C], shapes: list[tuple[int, int]], cameras: C, attempt: C | None = None) -> Column:
    """The shape that a row has; where its cameras do not allow it, one drawn from those that they do.

    Each attempt is a draw of its own.
    """
    own = F.struct(col(views).cast("long").alias("views"), col(latents).cast("long").alias("latents"))
    return F.when(col(views) <= col(cameras), own).otherwise(choose_shape([*key, *([] if attempt is None else [attempt])], shapes, cameras))


def first_attempt(place: Callable[[Column], Column], fits: Callable[[Column], Column], most: int = 20) -> Column:
    """(attempt, place) of the first of at most ``most`` drawn places that fits; null if none does."""
    tries = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda a: F.struct(a.alias("attempt"), place(a).alias("place")))
    return F.get(F.filter(tries, lambda t: F.coalesce(fits(t["place"]), F.lit(False))), F.lit(0))


def drawn_rows(draws: DataFrame, rows: DataFrame, group: list[str], draw: str, key: str, salt: str = "") -> DataFrame:
    """The row of each numbered draw of a group: without replacement while the group lasts, then with.

    Draws 0 to n - 1 go through a shuffle of the group's n rows; later ones are independent. A
    group without rows gives null.
    """
    k, at_row, at, n, *names = unused(draws, "key", "place", "at", "n", *[f"g_{c}" for c in group], *[f"s_{c}" for c in group])
    g, s = names[: len(group)], names[len(group) :]
    place = unused(rows.select(*group, key), "place")[0]
    places = shuffled(rows.select(*group, key), group, key, salt, place).select(*[F.col(c).alias(x) for c, x in zip(group, g, strict=True)], F.col(key).alias(k), F.col(place).alias(at_row))
    size = rows.groupBy(*[F.col(c).alias(x) for c, x in zip(group, s, strict=True)]).agg(F.count("*").alias(n))
    same = lambda xs: [F.col(c).eqNullSafe(F.col(x)) for c, x in zip(group, xs, strict=True)]
    out = draws.join(size, same(s), "left").withColumn(at, F.when(F.col(draw) < F.col(n), F.col(draw)).otherwise(integer_draw(n, *group, draw, salt=f"{salt}/again")))
    return out.join(places, [*same(g), F.col(at) == F.col(at_row)], "left").select(*[c for c in draws.columns if c != key], F.col(k).alias(key))


def conditioning_views(views: C, key: list[C], dropped: float, others: float, each: float) -> Column:
    """Views of a sample that condition it: view 0, and with probability ``others`` each further one with probability
    ``each``; with probability ``dropped`` none at all. An array of view numbers."""
    more = F.filter(F.sequence(F.lit(0), F.greatest(col(views) - 1, F.lit(0)).cast("int")), lambda v: (v == 0) | ((unit(*key, salt="other views") < others) & (unit(*key, v, salt="view") < each)))
    return F.when(unit(*key, salt="no views") < dropped, F.array().cast("array<int>")).otherwise(more)


def two_range_level(levels: int, boundary: int, step: C, *key: C) -> Column:
    """Noise level number drawn from one of two ranges: a coin by step, the same for all samples of it, says which."""
    high = unit(step, salt="high") < 0.5
    low = F.when(high, F.lit(0)).otherwise(F.lit(boundary))
    return low + integer_draw(F.when(high, F.lit(boundary)).otherwise(F.lit(levels - boundary)), step, *key, salt="level")


def ring_offsets(views: C, ring: C, spread: float, *key: C) -> Column:
    """Places of views spread evenly over a ring of cameras, each jittered (as a share of the ring); the first stays at 0."""
    from ..functions.scalar import normal_draw

    jittered = lambda v: F.pmod(F.floor((v / col(views) + normal_draw(*key, v, salt="ring") * spread) * col(ring) + 0.5).cast("long"), col(ring).cast("long"))
    return F.transform(F.sequence(F.lit(0), col(views).cast("int") - 1), lambda v: F.when(v == 0, F.lit(0).cast("long")).otherwise(jittered(v)))


def shared_walk(walk: DataFrame, views: DataFrame, key: list[str], ring: int, offsets: str) -> DataFrame:
    """Every view of a sample along one walk of (key, step, view, frame): its camera is the walk's, turned by the view's
    offset; frames are shared, so views stay in step. (key, step, place, camera, frame)."""
    (turn,) = unused(walk, "offset")
    each = views.select(*key, F.posexplode(offsets).alias("place", turn))
    return walk.select(*key, "step", "view", "frame").join(each, key).select(*key, "step", F.col("place").cast("long").alias("place"), F.pmod(F.col("view") + F.col(turn), F.lit(ring)).alias("camera"), "frame")
