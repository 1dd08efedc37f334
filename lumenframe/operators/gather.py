"""Plans for fetching frames of clips: which seeks, which frames to decode, and where each wanted frame goes.

Nothing is decoded here. A request names a clip and a list of frame numbers, in any order, with repeats, negative
ones (from the end) and ones beyond the clip. The plan has each distinct frame once; frames between the same two
keyframes share one seek, and so do neighbouring groups where decoding on costs no more than another seek.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import C, col
from ..tables import parts, unused


def in_clip(frame: C, n: C) -> Column:
    """A frame number brought into a clip of n frames: beyond the ends the end, negative ones from the end; null for an empty clip."""
    n = col(n)
    return F.when(n > 0, F.pmod(F.greatest(F.least(col(frame), n - 1), -n), n))


def last_at_most(values: C, x: C) -> Column:
    """The greatest of an ascending array's values that is at most ``x``, by halving; null if there is none."""
    values, x = col(values), col(x)

    def halve(s: Column, _: Column) -> Column:  # the answer's place, from 1, lies from lo to hi
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        fits = F.element_at(values, F.greatest(mid, F.lit(1))) <= x
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(F.greatest(mid - 1, s["lo"])).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    at = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi")), halve, lambda s: s["lo"])
    return F.when(at > 0, F.element_at(values, at))


def wanted_frames(requests: DataFrame, key: list[str], clip: str, frames: str, clips: DataFrame) -> DataFrame:
    """(key, clip, place, frame, ticks, keyframe): a row for each place of each request, from an index of clips.

    ``clips`` has (clip, n_frames, frame_ticks, keyframes) as ``container_index`` gives them. ``ticks`` is the frame's time on
    the grid of a constant rate; ``keyframe`` the frame to seek to, the last keyframe at or before it. Places of a clip that is
    not there, or has no frames, get nulls.
    """
    n, ticks, keys, there = unused(requests, "n_frames", "frame_ticks", "keyframes", "clip")
    side = clips.select(F.col(clip).alias(there), F.col("n_frames").alias(n), F.col("frame_ticks").alias(ticks), F.col("keyframes").alias(keys))
    # an index with its lists of keyframes is larger than Spark takes it for, so it is not left to it to send it to every task
    dealt = parts(requests)
    rows = requests.repartition(dealt, clip).join(side.hint("merge"), F.col(clip) == F.col(there), "left").select(*key, clip, n, ticks, keys, F.posexplode(frames).alias("place", "_f"))
    rows = rows.withColumn("frame", in_clip("_f", n).cast("long"))
    rows = rows.select(*key, clip, F.col("place").cast("long").alias("place"), "frame", (F.col("frame") * F.col(ticks)).alias("ticks"), F.when(F.col("frame").isNotNull(), F.coalesce(last_at_most(keys, "frame"), F.lit(0))).cast("long").alias("keyframe"))
    return rows.repartition(dealt, *key)  # by request, for its plan and its slots, which then need no further shuffle


def gather_slots(wanted: DataFrame, key: list[str]) -> DataFrame:
    """(key, place, slot): which of a request's distinct frames, in order, each of its places gets."""
    w = Window.partitionBy(*key).orderBy("frame")
    return wanted.where("frame IS NOT NULL").select(*key, "place", (F.dense_rank().over(w) - 1).cast("long").alias("slot"))


def gather_plan(wanted: DataFrame, key: list[str], clip: str, seek_cost: int = 0) -> DataFrame:
    """(key, clip, step, seek, last, n_wanted, n_decoded): the seeks of each request, in order.

    A step seeks to a keyframe and decodes up to the last frame wanted behind it. Where decoding on from there to the next group's
    keyframe takes at most ``seek_cost`` frames, the groups are one step. A request is one window; it is as long as its list.
    """
    groups = wanted.where("frame IS NOT NULL").groupBy(*key, clip, "keyframe").agg(F.max("frame").alias("last"), F.count_distinct("frame").alias("n_wanted"))
    w = Window.partitionBy(*key, clip).orderBy("keyframe")
    far = F.coalesce(F.col("keyframe") - F.lag("last").over(w) - 1 > seek_cost, F.lit(True)).cast("long")
    steps = groups.withColumn("_far", far).withColumn("step", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    out = steps.groupBy(*key, clip, "step").agg(F.min("keyframe").alias("seek"), F.max("last").alias("last"), F.sum("n_wanted").alias("n_wanted"))
    return out.select(*key, clip, "step", "seek", "last", "n_wanted", (F.col("last") - F.col("seek") + 1).alias("n_decoded"))
