"""Frames by the first way of sampling that yields any: each way is tried for the recordings that all ways before have left without a frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.operators.frames import frame_name, rounded_time
from chronoframe.operators.sampling import thinned
from chronoframe.sources.shared import written


class Stage(NamedTuple):
    """A way to sample: for which recordings, and their moments (key, idx, at)."""

    mode: str
    applies: Column
    moments: Callable[[DataFrame], DataFrame]


def fall_through(recordings: DataFrame, stages: Sequence[Stage], extract: Callable[[DataFrame], DataFrame], key: str = "video_id") -> tuple[DataFrame, DataFrame]:
    """(key, mode, idx, timestamp_seconds, path) of the frames, and (key, mode, frames) of each recording.

    `extract` takes moments (key, mode, idx, at) and returns those whose frame it could make; it is an adapter, so what it returns is written
    before it is used: no recording is asked for twice in a stage, and a later stage sees only recordings without a frame. A recording without any
    frame has the last stage's mode. One row per recording; null keys are left out.
    """
    left = recordings.where(recordings[key].isNotNull())
    every, made = left.select(key), []
    for stage in stages:
        moments = stage.moments(left.where(F.coalesce(stage.applies, F.lit(False)))).select(key, F.lit(stage.mode).alias("mode"), F.col("idx").cast("int").alias("idx"), "at")
        frames = written(extract(moments).select(key, "mode", "idx", rounded_time(F.greatest("at", F.lit(0.0))).alias("timestamp_seconds"), frame_name(F.col("idx")).alias("path")), "frames")
        made.append(frames)
        left = left.join(frames.select(key), key, "left_anti")
    out = made[0]
    for frames in made[1:]:
        out = out.unionByName(frames)
    counts = out.groupBy(key).agg(F.first("mode").alias("mode"), F.count("*").alias("frames"))  # a recording's frames are of one mode
    modes = every.join(counts, key, "left").select(key, F.coalesce("mode", F.lit(stages[-1].mode)).alias("mode"), F.coalesce("frames", F.lit(0)).alias("frames"))
    return out, modes


def listed(d: DataFrame, moments: Column, key: str = "video_id") -> DataFrame:
    """key, idx, at of an array of moments."""
    return d.select(key, F.posexplode(moments).alias("idx", "at"))


def scene_moments(scenes: DataFrame, most: int, key: str = "video_id") -> DataFrame:
    """key, moments: the midpoints of a recording's scenes, thinned to at most so many; scenes beyond what thinning keeps are never gathered.

    scenes: key, scene_no, start, end.
    """
    n = F.count("*").over(Window.partitionBy(key))
    numbered = scenes.select(key, ((F.col("start") + F.col("end")) / 2).alias("at"), (F.row_number().over(Window.partitionBy(key).orderBy("start", "scene_no")) - 1).alias("i"), n.cast("int").alias("n"))
    places = thinned(F.sequence(F.lit(0), F.col("n") - 1), F.lit(most))
    kept = numbered.where((F.col("n") <= most) | F.array_contains(places, F.col("i"))) if most > 0 else numbered.limit(0)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "at"))), lambda x: x["at"]).alias("moments"))
