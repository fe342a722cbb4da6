"""Activity windows over a stream of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_windows(segments: DataFrame, gap: str = "6 hours", late: str | None = None, key: str = "video_id") -> DataFrame:
    """segments: key, at TIMESTAMP, seconds DOUBLE. Returns key, start, end, n as session windows close.

    A segment's session lasts its own length and the gap, so windows merge under the same rule as in batch: the next begins
    at most a gap after the latest end. `late` sets a watermark for streams; segments later than that are dropped.
    """
    d = segments.withWatermark("at", late) if late else segments
    micros = F.round(F.col("seconds") * 1_000_000).cast("long")
    d = d.withColumn("until", F.timestamp_add("MICROSECOND", micros, F.col("at")))
    lasting = F.concat(micros.cast("string"), F.lit(f" microseconds {gap}"))
    return d.groupBy(key, F.session_window("at", lasting)).agg(F.min("at").alias("start"), F.max("until").alias("end"), F.count("*").alias("n")).drop("session_window")
