"""One of several candidates: sources by priority, subtitle and video files, the way frames are sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Video extensions in order of preference, then the others that are known.
PREFERRED, KNOWN = ("mp4", "mkv", "webm", "mov"), ("mp4", "mkv", "webm", "mov", "m4v", "avi", "flv", "wmv")


def by_priority(candidates: DataFrame, filled: Column, key: str = "video_id") -> DataFrame:
    """The candidate with the least priority among those that hold anything, one row per key."""
    names = [c for c in candidates.columns if c != key]
    best = candidates.where(filled).groupBy(key).agg(F.min_by(F.struct(*names), "priority").alias("c"))
    return best.select(key, "c.*")


def subtitle(files: DataFrame, key: str = "video_id", name: str = "name") -> DataFrame:
    """key, name: the first by name whose name holds '.en', else the first."""
    return files.where(F.col(name).rlike(r"^video.*\.vtt$")).groupBy(key).agg(F.min_by(name, F.struct(~F.contains(F.col(name), F.lit(".en")), F.col(name))).alias(name))


def video(files: DataFrame, key: str = "video_id", name: str = "name") -> DataFrame:
    """key, name: by extension in order of preference, then by name."""
    extension = F.lower(F.element_at(F.split(F.col(name), r"\."), -1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in PREFERRED]), extension), F.lit(0).cast("long")), F.lit(len(PREFERRED) + 1))
    return files.where(extension.isin(*KNOWN)).groupBy(key).agg(F.min_by(name, F.struct(rank, F.col(name))).alias(name))


def sampling_mode(two_pass: Column, scene_detect: Column, fps: Column, n_windows: Column, n_scenes: Column) -> Column:
    """two-pass where asked for and speech is known, else scenes, else fps; a fixed rate rules out the first two."""
    free = fps.isNull()
    return F.when(free & two_pass & (n_windows > 0), "two-pass").when(free & scene_detect & (n_scenes > 0), "scenes").otherwise("fps")


def scope(duration: Column, start: Column, end: Column) -> tuple[Column, Column, Column, Column]:
    """Effective start, end and duration, and whether only a part is asked for."""
    s, e = F.coalesce(start, F.lit(0.0)), F.coalesce(end, duration)
    return s, e, F.greatest(F.lit(0.0), e - s), start.isNotNull() | end.isNotNull()


def scope_fault(duration: Column, start: Column, end: Column) -> Column:
    """What is wrong with a requested part, or null; an end without a start is never wrong. routing.time_faults tells all faults."""
    return F.when(start < 0, "start is negative").when(end <= start, "end is not after start").when((duration > 0) & (start >= duration), "start is past the end")
