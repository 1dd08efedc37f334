"""Row predicates and normalisations of clip manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import C, col, half_even, normal_path, strip
from ..tables import prefix


def _blank(p: Column) -> Column:
    return F.coalesce(strip(p) == "", F.lit(True))


def _ends_in_slash(p: Column) -> Column:
    return p.endswith("/") | p.endswith("\\")


def malformed_paths(mode: C, views: C, paths: C, roots: C) -> Column:
    """Whether the listed paths cannot name the views of a sample: wrong count, blank, the root itself, a folder.

    Augmented samples (mode ``aug``) are checked for count and blanks only.
    """
    m, n, p, r = (col(x) for x in (mode, views, paths, roots))
    count = F.coalesce(n <= 0, F.lit(True)) | (F.coalesce(F.size(p), F.lit(-1)) != n) | (F.coalesce(F.size(r), F.lit(-1)) != n)
    blank = F.exists(p, _blank)
    own = F.arrays_zip(p.alias("p"), r.alias("r"))
    odd = F.exists(own, lambda x: F.coalesce((strip(x["r"]) != "") & (normal_path(strip(x["p"])) == normal_path(strip(x["r"]))), F.lit(False)) | F.coalesce(_ends_in_slash(strip(x["p"])), F.lit(False)))
    return F.when(count, F.lit(True)).when(blank, F.lit(True)).when(m == "aug", F.lit(False)).otherwise(odd)


def split_valid(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(rows to use, rejected rows); both keep their physical row ids."""
    flag = F.coalesce(bad, F.lit(True))
    return df.where(~flag), df.where(flag)


def complete_paths(paths: C, views: C, nested: bool = False) -> Column:
    """Whether each of the first ``views`` entries is a path (or, nested, a nonempty list of paths) and no folder."""
    good = lambda p: ~_blank(p) & ~F.coalesce(_ends_in_slash(F.regexp_replace(p, r"\s+$", "")), F.lit(True))
    first = F.slice(col(paths), F.lit(1), F.greatest(col(views), F.lit(0)).cast("int"))
    check = (lambda v: F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, good), F.lit(False))) if nested else good
    return F.coalesce((col(views) > 0) & (F.size(col(paths)) >= col(views)) & F.forall(first, check), F.lit(False))


def source_frames(latents) -> Column:
    """Source frames that so many latents cover: the first covers one, each further one four."""
    return 4 * (latents if isinstance(latents, Column) else F.lit(latents)) - 3


def viable(num_frames: C, fps: C, latents: list[int], stride_ratio: C | None = None, fps_targets: list[float] | None = None) -> Column:
    """Whether a clip is long enough for the least of the enabled lengths.

    With fixed rate targets, one must not exceed the source's rate, and the length is
    scaled by ``stride_ratio``; otherwise the native rate will do.
    """
    n, need = col(num_frames), source_frames(min(latents))
    if fps_targets is None:
        return F.coalesce(n >= need, F.lit(False))
    ratio = F.greatest(F.lit(1.0), col(stride_ratio)) if stride_ratio is not None else F.lit(1.0)
    usable = F.size(F.filter(F.array(*[F.lit(float(t)) for t in fps_targets]), lambda t: t <= col(fps))) > 0
    return F.coalesce(usable & (n > 0) & (n >= half_even(need * ratio)), F.lit(False))


def least_frames(num_frames: C) -> Column:
    """Frames of a row whose views have counts of their own: the least; null for an empty list."""
    return F.array_min(col(num_frames))


def slice_rows(df: DataFrame, order: list[str], start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop, counted from 0 in the given total order."""
    hid = prefix(df)
    from .sampling import numbered

    df = numbered(df, order, f"{hid}n")
    lo = start or 0
    keep = (F.col(f"{hid}n") >= lo) & (F.pmod(F.col(f"{hid}n") - lo, F.lit(step)) == 0)
    if stop is not None:
        keep &= F.col(f"{hid}n") < stop
    return df.where(keep).drop(f"{hid}n")


def window_bounds(frame_start: C, frame_end: C) -> tuple[Column, Column]:
    """Start (0 if absent) and end (null for the whole clip: absent, zero or negative)."""
    return F.coalesce(col(frame_start), F.lit(0)), F.when(col(frame_end) > 0, col(frame_end))


def effective_length(frame_start: C, frame_end: C, n_video: C, n_camera: C) -> Column:
    """Frames of the window that exist. Tracks that differ by at most one frame count as the shorter."""
    v, c = col(n_video), col(n_camera)
    full = F.when(F.abs(c - v) <= 1, F.least(c, v)).otherwise(v)
    start, end = window_bounds(frame_start, frame_end)
    return F.greatest(F.lit(0), F.least(F.coalesce(end, full), full) - start)


def runtime_shape(df: DataFrame, views: str, latents: str, table: dict[str, str | int], isolated: str | None = None, max_views: int = 0, max_latents: int = 0) -> DataFrame:
    """Add ``rt_views`` and ``rt_latents``: the remapped and capped shape, never larger than the stored one, never under 1.

    The remap table has one entry per shape of a recipe, a few dozen rows, and is broadcast as such.
    """
    hid = prefix(df)
    spark = df.sparkSession
    rows = []
    for k, v in table.items():
        a, b = (int(x) for x in k.split("x"))
        to = [int(x) for x in v.split("x")] if isinstance(v, str) and "x" in v else [a, int(v)]
        rows.append((a, b, to[0], to[1]))
    remap = spark.createDataFrame(rows, f"{hid}v long, {hid}l long, {hid}tv long, {hid}tl long")
    out = df.join(F.broadcast(remap), (F.col(views) == F.col(f"{hid}v")) & (F.col(latents) == F.col(f"{hid}l")), "left")
    v, g = F.coalesce(f"{hid}tv", F.col(views).cast("long")), F.coalesce(f"{hid}tl", F.col(latents).cast("long"))
    if max_views > 0:
        capped = F.least(v, F.lit(max_views))
        v = F.when(F.coalesce(F.col(isolated), F.lit(False)), v).otherwise(capped) if isolated else capped
    if max_latents > 0:
        g = F.least(g, F.lit(max_latents))
    shape = {"rt_views": F.greatest(F.lit(1), F.least(v, F.col(views))), "rt_latents": F.greatest(F.lit(1), F.least(g, F.col(latents)))}
    return out.withColumns(shape).drop(f"{hid}v", f"{hid}l", f"{hid}tv", f"{hid}tl")


def truncated(values: C, n: C) -> Column:
    """The first n entries of a list."""
    return F.slice(col(values), F.lit(1), F.greatest(col(n), F.lit(0)).cast("int"))


def scaled_count(count: C, latents: C, full: C) -> Column:
    """Captions left after truncation from ``full`` to ``latents``: in proportion, at least 1."""
    return F.greatest(F.lit(1), F.floor(col(count) * col(latents) / col(full)).cast("long"))


def status(count: C, least: int) -> Column:
    """EMPTY, TOO FEW or OK."""
    return F.when(col(count) == 0, "EMPTY").when(col(count) < least, "TOO FEW").otherwise("OK")


def finite(x: C) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    v = col(x).cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))


def finite_positive(x: C) -> Column:
    return finite(x) & (col(x) > 0)


def chosen_text(first: C, second: C, dynamic: C, draw: C) -> Column:
    """The one that is present; where both are, the second if the clip is dynamic and the draw is under a half."""
    a, b = F.nullif(strip(first), F.lit("")), F.nullif(strip(second), F.lit(""))
    return F.when(a.isNull(), b).when(b.isNull(), a).when(col(dynamic) & (col(draw) < 0.5), b).otherwise(a)


def short_clips(df: DataFrame, length: str, window: int = 77) -> DataFrame:
    """One row per window of at most ``window`` units, to the end of the clip: clip, start, stop."""
    count = F.greatest(F.ceil(F.col(length) / window), F.lit(1)).cast("long")
    out = df.withColumn("clip", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return out.withColumns({"start": F.col("clip") * window, "stop": F.least((F.col("clip") + 1) * window, F.col(length).cast("long"))})


def restored_scale(values: Column, scale: C) -> Column:
    """Translations in their recorded scale; unchanged where the scale is 1 or absent."""
    s = F.coalesce(col(scale), F.lit(1.0))
    return F.when(s == 1.0, values).otherwise(F.transform(values, lambda v: v * s))
