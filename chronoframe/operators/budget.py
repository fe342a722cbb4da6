"""How many moments to sample: budgets by duration, and their division over intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.functions.scalar import bound, half_even

#: Frames per second at most, frames at most, share of frames for speech.
MAX_FPS, MAX_FRAMES, SPEECH_SHARE = 2.0, 100, 0.7


def _clamped(duration: Column, target: Column, cap: Column) -> tuple[Column, Column]:
    fps = F.least(target / duration, F.lit(MAX_FPS))
    return fps, F.least(cap, F.greatest(F.lit(1), half_even(fps * duration)))


def _budget(duration: Column, target: Column, cap: Column, fps0: float, n0: int) -> tuple[Column, Column]:
    known = duration > 0
    fps, n = _clamped(F.when(known, duration), F.least(target, cap), cap)
    return F.when(known, fps).otherwise(F.lit(fps0)), F.when(known, n).otherwise(F.lit(n0)).cast("long")


def full_budget(duration: Column, max_frames: Column) -> tuple[Column, Column]:
    """(fps, frames) for a whole recording."""
    t = F.when(duration <= 30, F.greatest(F.lit(12), half_even(duration))).when(duration <= 60, F.lit(40)).when(duration <= 180, F.lit(60)).when(duration <= 600, F.lit(80)).otherwise(max_frames)
    return _budget(duration, t, max_frames, 1.0, 1)


def focus_budget(duration: Column, max_frames: Column) -> tuple[Column, Column]:
    """(fps, frames) for a part of a recording, sampled more densely."""
    t = F.when(duration <= 5, F.greatest(F.lit(10), half_even(duration * 6))).when(duration <= 15, F.greatest(F.lit(30), half_even(duration * 4))).when(duration <= 30, F.lit(60)).when(duration <= 60, F.lit(80)).otherwise(max_frames)
    return _budget(duration, t, max_frames, 2.0, 2)


def fixed_rate_budget(duration: Column, fps: Column) -> tuple[Column, Column]:
    """(fps, frames) for a rate that is asked for; the number is not capped here, only what is extracted is."""
    rate = F.least(fps, F.lit(MAX_FPS))
    return rate, F.greatest(F.lit(1), half_even(rate * duration)).cast("long")


def speech_and_silence(max_frames: Column, speech_len: Column, silent_len: Column, share: float = SPEECH_SHARE) -> tuple[Column, Column]:
    """Frames for speech and for the rest; a side with any length gets at least one, the silent one if there are two."""
    speech = half_even(max_frames * F.lit(share))
    speech = F.greatest(speech, F.lit(1))
    silent = max_frames - speech
    short = (silent < 1) & (max_frames > 1)
    speech, silent = F.when(short, max_frames - 1).otherwise(speech), F.when(short, F.lit(1)).otherwise(F.greatest(silent, F.lit(0)))
    no_speech, no_silence = speech_len <= 0, silent_len <= 0
    return (
        F.when(no_speech, F.lit(0)).when(no_silence, max_frames).otherwise(speech).cast("long"),
        F.when(no_speech, max_frames).when(no_silence, F.lit(0)).otherwise(silent).cast("long"),
    )


def allocated(intervals: DataFrame, key: str = "video_id") -> DataFrame:
    """intervals: key, win, start, end, budget (one per key). Adds `frames`, the interval's part of the budget.

    Parts are proportional to length, rounded half-even, at least 1. While they exceed the budget the largest is lowered by
    one, the first of equals, never below 1: the units above 1 are ranked by height and the first of them taken away. A
    deficit goes as a whole to the longest interval, the first of equals.
    """
    per_key = Window.partitionBy(key)
    length = F.col("end") - F.col("start")
    d = intervals.withColumn("len", length).withColumn("total", F.sum(length).over(per_key))
    d = d.withColumn("n", F.greatest(F.lit(1), half_even(F.col("budget") * (F.col("len") / F.col("total")))))
    d = d.withColumn("over", F.sum("n").over(per_key) - F.col("budget"))
    d = d.withColumn("longest", F.row_number().over(per_key.orderBy(F.col("len").desc(), "win")) == 1)
    units = d.where("over > 0 and n > 1").select(key, "win", "over", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("height"))
    ranked = units.withColumn("rank", F.row_number().over(per_key.orderBy(F.col("height").desc(), "win")))
    less = ranked.where("rank <= over").groupBy(key, "win").agg(F.count("*").alias("less"))
    d = d.join(less, [key, "win"], "left")
    frames = F.col("n") - F.coalesce("less", F.lit(0)) + F.when((F.col("over") < 0) & F.col("longest"), -F.col("over")).otherwise(F.lit(0))
    return d.withColumn("frames", frames.cast("long")).drop("len", "total", "n", "over", "longest", "less")


def shares(lengths: Column, total: Column, budget: Column) -> Column:
    """The parts of a budget by length, as `allocated` gives them, of one array of lengths in the order of their intervals.

    Lowering the largest until the sum fits ends with a level: all that stand above it come down to it, and of those on it the first few
    go one lower. The level is the least at which what stands above it is not more than has to go; only lengths with over one
    frame, fewer than the budget, are looked at for it.
    """
    add = lambda a, x: a + x
    zero = F.lit(0).cast("long")

    def fitted(n: Column) -> Column:
        over = F.aggregate(n, zero, add) - budget
        tall = F.filter(n, lambda x: x > 1)

        def lowered(v: Column) -> Column:
            """v: over, tall, and the level."""
            cut = lambda level: F.aggregate(v["tall"], zero, lambda a, x: a + F.greatest(x - level, zero))
            rest = (v["over"] - cut(v["level"])).cast("int")
            on_it = F.transform(F.filter(F.transform(n, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["x"] >= v["level"]), lambda p: p["i"])
            first = F.when(v["level"] > 1, F.slice(on_it, F.lit(1), rest)).otherwise(F.array().cast("array<int>"))
            return bound(first, lambda f: F.transform(n, lambda x, i: F.least(x, v["level"]) - F.array_contains(f, i).cast("long")))

        above = lambda level: F.aggregate(tall, zero, lambda a, x: a + F.greatest(x - level, zero))
        level = F.get(F.filter(F.sequence(F.lit(1).cast("long"), F.array_max(n)), lambda x: above(x) <= over), 0)
        longest = F.array_position(lengths, F.array_max(lengths)) - 1
        return F.when(over > 0, bound(F.struct(over.alias("over"), tall.alias("tall"), level.alias("level")), lowered)).otherwise(F.transform(n, lambda x, i: x + F.when(i == longest, -over).otherwise(zero)))

    parts = F.transform(lengths, lambda x: F.greatest(F.lit(1).cast("long"), half_even(budget * (x / total))))
    return F.when(F.size(lengths) > 0, bound(parts, fitted)).otherwise(F.array().cast("array<bigint>"))

