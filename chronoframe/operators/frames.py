"""Frame tables: times at a fixed rate, frames at given moments with holes, scenes from scores, and the answer of a chain of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.functions.scalar import exact_round
from chronoframe.operators.budget import MAX_FRAMES
from chronoframe.sources.media import frame_times  # noqa: F401

#: Fixed value: the score from which on a frame begins a scene.
THRESHOLD = 27.0


def rounded_time(seconds: Column) -> Column:
    """To hundredths, ties to even by binary value."""
    return exact_round(2)(seconds)


def frame_name(idx: Column) -> Column:
    n = idx + 1  # padding is many times faster than formatting
    return F.when((n > 0) & (n < 10000), F.concat(F.lit("frame_"), F.lpad(n.cast("string"), 4, "0"), F.lit(".jpg"))).otherwise(F.format_string("frame_%04d.jpg", n))


def at_fixed_rate(ranges: DataFrame, key: list[str]) -> DataFrame:
    """key columns, idx, timestamp_seconds, path. ranges: key columns, start, fps, frames; at most MAX_FRAMES frames of a range, none if fewer than 1."""
    n = F.least("frames", F.lit(MAX_FRAMES)).cast("int")
    numbered = ranges.where(n > 0).select(*key, "start", "fps", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).alias("idx"))
    # rows of numbers, as a function over an array of times does not become generated code
    return numbered.select(*key, "idx", rounded_time(F.col("start") + F.col("idx") / F.col("fps")).alias("timestamp_seconds"), frame_name(F.col("idx")).alias("path"))


def at_moments(moments: DataFrame, extracted: DataFrame, key: str = "video_id") -> DataFrame:
    """key, idx, timestamp_seconds, path of the moments that could be extracted; idx counts all moments of a key in order, so failed ones leave holes.

    moments: key, at. extracted: key, at. Repeated moments keep their rows; null moments count as failed.
    """
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.col("at").asc_nulls_last()))
    numbered = moments.select(key, "at", (order - 1).alias("idx"))
    return numbered.join(extracted.select(key, "at"), [key, "at"], "left_semi").select(key, "idx", rounded_time(F.col("at")).alias("timestamp_seconds"), frame_name(F.col("idx")).alias("path"))


def scenes_of(scores: DataFrame, threshold: float = THRESHOLD, key: str = "video_id") -> DataFrame:
    """key, scene_no, start, end: a scene begins at the first frame and at every later one whose score reaches the threshold; the last ends with the last frame.

    scores: key, at, score. A key without a cut after its first frame has no row; null scores cut nothing.
    """
    w = Window.partitionBy(key).orderBy("at")
    marked = scores.where("at is not null").select(key, "at", F.row_number().over(w).alias("n"), F.max("at").over(Window.partitionBy(key)).alias("last"), (F.col("score") >= threshold).alias("cut"))
    begins = marked.where((F.col("n") == 1) | F.col("cut"))
    listed = begins.select(key, (F.row_number().over(w) - 1).alias("scene_no"), F.col("at").alias("start"), F.coalesce(F.lead("at").over(w), F.col("last")).alias("end"), F.count("*").over(Window.partitionBy(key)).alias("scenes"))
    return listed.where("scenes > 1").drop("scenes")


def by_chain(attempts: DataFrame, chain: list[str], key: str = "video_id") -> DataFrame:
    """key, model, segments of the first model of the chain that did not fail. A model named twice is tried once; an empty array is an answer and ends the chain.

    attempts: key, model, segments ARRAY, null where the model failed. Other models are not asked; a key whose models all failed has no row.
    """
    rank = F.array_position(F.array(*[F.lit(m) for m in dict.fromkeys(chain)]), F.col("model"))
    answered = attempts.where(F.col("segments").isNotNull() & (rank > 0))
    return answered.groupBy(key).agg(F.min_by(F.struct("model", "segments"), F.struct(rank, "segments")).alias("a")).select(key, "a.model", "a.segments")


def backend_label(backend: Column, model: Column, diarized: Column, separate_audio: Column) -> Column:
    """What made a transcript: the backend with the local model's name or diarization, and whether the sound came from its own file."""
    inner = F.when(backend == "local", F.concat(F.lit("local, "), model)).when((backend == "assemblyai") & diarized, F.lit("assemblyai, diarized")).otherwise(backend)
    return F.concat(F.lit("whisper ("), inner, F.when(separate_audio, F.lit(", --audio")).otherwise(F.lit("")), F.lit(")"))
