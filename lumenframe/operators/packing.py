"""Token offsets, padding, segment order and nested-list layouts of packed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import C, ceil_div, col, half_even, lcm, whole_div
from ..tables import prefix
from .sampling import MOST_CHOICES, bounded, numbered, running_in_groups


def running_offsets(df: DataFrame, by: list[str], order: list[str], size: str, name: str = "offset") -> DataFrame:
    """Exclusive running sum of sizes in each group; a large group is summed in parts."""
    return running_in_groups(df, by, order, F.col(size).cast("long"), name)


def padding(length: C, multiple: C) -> Column:
    """Tokens to add until the length is a multiple."""
    m = multiple if isinstance(multiple, Column) else F.lit(multiple)
    return F.pmod(-col(length), m)


def padded_length(length: C, parallel: C, bucket: C) -> Column:
    """Length up to a multiple of both the parallel degree and the bucket."""
    m = lcm(parallel, bucket)
    return col(length) + padding(length, m)


def padded_rows(df: DataFrame, by: list[str], order: str, multiple: int, repeat_last: bool = True) -> DataFrame:
    """Add rows until each group's count is a multiple: copies of its last row, or rows of nulls. ``pad`` marks them."""
    hid = prefix(df)
    last = df.groupBy(*by).agg(F.count("*").alias(f"{hid}n"), F.max_by(F.struct(*df.columns), order).alias(f"{hid}last"), F.max(order).alias(f"{hid}top"))
    more = last.withColumn(f"{hid}add", F.pmod(-F.col(f"{hid}n"), F.lit(multiple))).where(f"{hid}add > 0").withColumn(f"{hid}k", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{hid}add"))))
    values = [F.col(c) if c in by else (F.col(f"{hid}top") + F.col(f"{hid}k")).alias(c) if c == order else (F.col(f"{hid}last.{c}") if repeat_last else F.lit(None)).alias(c) for c in df.columns]
    return df.withColumn("pad", F.lit(False)).unionByName(more.select(*values, F.lit(True).alias("pad")))


def text_origin(df: DataFrame, by: list[str], tokens: str, chunk: str, name: str = "origin") -> DataFrame:
    """Tokens of chunks at or before 0 in each group, on every row: where the time of its text begins."""
    return df.withColumn(name, F.coalesce(F.sum(F.when(F.col(chunk) <= 0, F.col(tokens))).over(Window.partitionBy(*by)), F.lit(0)).cast("long"))


def segment_order(df: DataFrame, by: list[str], segment: str, order: list[str], first: list[str], name: str = "place") -> DataFrame:
    """Place of each row when segments follow the given list, then the order; unlisted segments come last."""
    rank = F.coalesce(*[F.when(F.col(segment) == s, F.lit(i)) for i, s in enumerate(first)], F.lit(len(first)))
    w = Window.partitionBy(*by).orderBy(rank, *order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def dense_levels(df: DataFrame, columns: list[str], name: str = "level") -> DataFrame:
    """Number of each row's combination of values among the sorted distinct ones, from 0.

    Distinct combinations are numbered on their own and joined back, so only they are sorted.
    """
    hid = prefix(df)
    from .joins import small

    keys = numbered(df.select(*columns).distinct(), columns, name)
    side = keys.withColumnsRenamed({c: f"{hid}k_{c}" for c in columns})
    same = F.lit(True)
    for c in columns:
        same = F.col(c).eqNullSafe(F.col(f"{hid}k_{c}")) & same
    return df.join(small(side), same).drop(*[f"{hid}k_{c}" for c in columns])


def exploded_views(df: DataFrame, keep: list[str], lists: list[str], views: str | None = None) -> DataFrame:
    """One row per sample and view from per-view lists, sample-major; a list whose length is not the view count gives nulls."""
    hid = prefix(df)
    n = F.col(views) if views else F.size(lists[0])
    zipped = F.arrays_zip(*[F.when(F.size(c) == n, F.col(c)).otherwise(F.array()).alias(c) for c in lists])
    return df.select(*keep, F.posexplode(zipped).alias("view", f"{hid}v")).select(*keep, F.col("view").cast("long").alias("view"), *[F.col(f"{hid}v.{c}").alias(c) for c in lists])


def untiled(df: DataFrame, canvas: str, width: int, height: int, layout: DataFrame, frames: int = 1) -> DataFrame:
    """The views of a packed canvas: a row (view, view_height, view_width, pixels) for each view of each row.

    ``canvas`` is a flat array of ``frames`` images of ``height`` by ``width``; ``layout`` has (view, scale, x, y), the share of the
    canvas' sides that a view takes and where it begins, as a recipe gives it (some tens of rows). Sides and places are rounded half to even, and
    a view ends where the canvas does. ``pixels`` is flat again, frame by frame, row by row. A null canvas gives nulls.
    """
    hid = prefix(df)
    side = lambda share, n: half_even(F.col(share) * n).cast("int")
    box = layout.select(F.col("view").cast("long").alias("view"), side("x", width).alias("x"), side("y", height).alias("y"), side("scale", width).alias("w"), side("scale", height).alias("h"))
    box = box.withColumns({"w": F.greatest(F.least("w", F.lit(width) - F.col("x")), F.lit(0)), "h": F.greatest(F.least("h", F.lit(height) - F.col("y")), F.lit(0))})
    table = bounded(box, MOST_CHOICES, "views").agg(F.array_sort(F.collect_list(F.struct("view", "x", "y", "w", "h"))).alias(f"{hid}boxes"))
    keep = [c for c in df.columns if c not in ("view", "view_height", "view_width", "pixels")]
    rows = df.join(F.broadcast(table)).select(*df.columns, F.explode(f"{hid}boxes").alias(f"{hid}b"))
    b = F.col(f"{hid}b")
    line = lambda t, r: F.slice(F.col(canvas), (t * height + r) * width + b["x"] + 1, b["w"])
    lines = F.when(b["h"] > 0, F.sequence(b["y"], b["y"] + b["h"] - 1)).otherwise(F.array().cast("array<int>"))
    pixels = F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: F.transform(lines, lambda r: line(t, r)))))
    return rows.select(*keep, b["view"].alias("view"), b["h"].cast("long").alias("view_height"), b["w"].cast("long").alias("view_width"), F.when(F.col(canvas).isNotNull(), pixels).alias("pixels"))


def gathered_views(df: DataFrame, by: list[str], view: str, columns: list[str]) -> DataFrame:
    """The reverse: one row per sample with per-view lists in view order."""
    hid = prefix(df)
    both = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(view, *columns))).alias(f"{hid}v"))
    return both.select(*by, F.size(f"{hid}v").alias("views"), *[F.col(f"{hid}v.{c}").alias(c) for c in columns])


def tile_starts(length: C, tile: int, overlap: int, unit: int = 1) -> Column:
    """Starts of the fewest tiles that cover the length and overlap by at least ``overlap``.

    What the tiles cover beyond the length widens the overlaps, from the first on, one ``unit``
    each in turn, so that all starts stay on multiples of it; less than a unit is left over and
    reaches beyond the end. A length of at most one tile has one.
    """
    n = F.when(col(length) <= tile, F.lit(1)).otherwise(ceil_div(col(length) - overlap, tile - overlap)).cast("long")
    units = whole_div(F.greatest(tile * n - overlap * (n - 1) - col(length), F.lit(0)), F.lit(unit))
    gaps = F.greatest(n - 1, F.lit(1))
    share, rest = whole_div(units, gaps), units % gaps
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * (tile - overlap) - unit * (i * share + F.least(i, rest)))


def sub_ranges(df: DataFrame, keep: list[str], values: str) -> DataFrame:
    """Every contiguous, nonempty part of a list: (start, stop, part)."""
    out = df.select(*keep, values, F.explode(F.sequence(F.lit(0), F.size(values) - 1)).alias("start"))
    out = out.withColumn("stop", F.explode(F.sequence(F.col("start") + 1, F.size(values))))
    return out.select(*keep, F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.slice(values, F.col("start") + 1, F.col("stop") - F.col("start")).alias("part"))


def patch_places(height: str, width: str) -> Column:
    """A grid's pixels with their place in the order of its 2 x 2 patches: an array of (row, col, place). A last odd row or column is in no patch."""
    h, w = (F.floor(F.col(n) / 2).cast("long") for n in (height, width))
    axis = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), 2 * n - 1)).otherwise(F.array().cast("array<bigint>"))
    place = lambda r, c: 4 * (whole_div(r, F.lit(2)) * w + whole_div(c, F.lit(2))) + 2 * (r % 2) + c % 2
    return F.flatten(F.transform(axis(h), lambda r: F.transform(axis(w), lambda c: F.struct(r.alias("row"), c.alias("col"), place(r, c).cast("long").alias("place")))))


def spatial_grid(height: str, width: str) -> Column:
    """Positions of a grid's patches, centred and scaled to the same area for every aspect: an array of (y, x)."""
    area = F.sqrt(F.col(height).cast("double") * F.col(width))
    axis = lambda n, i: ((1 - n / area) / 2 + i * ((n / area) / F.floor(n / 2))) * 32
    ys = F.sequence(F.lit(0), F.floor(F.col(height) / 2).cast("int") - 1)
    xs = F.sequence(F.lit(0), F.floor(F.col(width) / 2).cast("int") - 1)
    return F.flatten(F.transform(ys, lambda i: F.transform(xs, lambda j: F.struct(axis(F.col(height), i).alias("y"), axis(F.col(width), j).alias("x")))))


def tile_weight(width: C, tile: C, size: int = 32) -> Column:
    """Share of a tile that lies inside the picture."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (col(width) - size * col(tile)) / F.lit(float(size))))


def unsharded(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Sum values that fall on the same key: a scatter-add."""
    return df.groupBy(*key).agg(F.sum(value).alias(value))
