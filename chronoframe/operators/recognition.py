"""Recognised on-screen words: confidence filter, join with frames, frames worth a larger image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.scalar import is_significant, strip

#: Confidence from which a word counts, pixels of a large image.
MIN_CONFIDENCE, LARGE_WIDTH = 50.0, 1024


def confident_text(words: Column, confidences: Column, least: float = MIN_CONFIDENCE) -> Column:
    """Words whose confidence is a number of at least `least` (NaN counts), stripped, blank ones left out, joined by spaces."""
    pairs = F.arrays_zip(words.alias("w"), confidences.alias("c"))
    sure = F.filter(pairs, lambda p: p["c"].try_cast("double") >= least)
    return F.array_join(F.filter(F.transform(sure, lambda p: strip(p["w"])), lambda w: w != ""), " ")


def with_text(frames: DataFrame, texts: DataFrame, on: str = "path") -> DataFrame:
    """Frames with their text, '' where none was recognised."""
    return frames.join(texts.select(on, "text"), on, "left").withColumn("text", F.coalesce("text", F.lit("")))


def target_width(text: Column, resolution: Column) -> Column:
    """The width at which a frame is wanted: large if its text is significant and it is smaller than that."""
    return F.when(is_significant(text) & (resolution < LARGE_WIDTH), F.lit(LARGE_WIDTH)).otherwise(resolution)
