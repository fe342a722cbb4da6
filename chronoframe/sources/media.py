"""Reading captions, metadata and frame tables; contracts for what other programs produce."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions.scalar import first_filled, lenient_text

SEGMENTS = "video_id string, seq long, start double, end double, text string, speaker string"
SCENES = "video_id string, scene_no int, start double, end double"
FRAMES = "video_id string, idx int, timestamp_seconds double, path string"
WORDS = "video_id string, path string, text array<string>, conf array<string>"
_INFO = "struct<title:string,uploader:string,channel:string,duration:double,webpage_url:string>"
_PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string>>,format:struct<duration:string,size:string>>"


def caption_files(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the file's folder), name, value: whole texts of caption files, without the bytes that are not UTF-8. Spark's readers pass over empty files."""
    d = spark.read.format("binaryFile").load(path)
    parts = F.split("path", "/")
    return d.select(F.element_at(parts, -2).alias("video_id"), F.element_at(parts, -1).alias("name"), lenient_text(F.col("content")).alias("value"))


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, known: files with whether their extension is a known one. Contents are not read."""
    from chronoframe.operators.selection import KNOWN

    name = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select("path", name.alias("name"), F.col("length").alias("size"), F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*KNOWN).alias("known"))


def info(raw: Column, source: Column) -> Column:
    """title, uploader (else channel), duration, url (else the source) of a JSON document; what cannot be read leaves the source."""
    j = F.from_json(raw, _INFO)
    return F.struct(j["title"].alias("title"), first_filled(j["uploader"], j["channel"]).alias("uploader"), j["duration"].alias("duration"), F.coalesce(F.nullif(j["webpage_url"], F.lit("")), source).alias("url"))


def probe(raw: Column) -> Column:
    """duration_seconds, width, height, codec, size_bytes, has_audio of a container's JSON: the first video stream and any audio."""
    j = F.from_json(raw, _PROBE)
    streams = F.coalesce(j["streams"], F.from_json(F.lit("[]"), "array<struct<codec_type:string,codec_name:string,width:int,height:int,duration:string>>"))
    v = F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), 0)
    duration = F.coalesce(F.nullif(j["format"]["duration"], F.lit("")), F.nullif(v["duration"], F.lit("")), F.lit("0")).try_cast("double")
    return F.struct(
        F.coalesce(duration, F.lit(0.0)).alias("duration_seconds"), v["width"].alias("width"), v["height"].alias("height"), v["codec_name"].alias("codec"),
        F.coalesce(j["format"]["size"].try_cast("long"), F.lit(0).cast("long")).alias("size_bytes"), F.exists(streams, lambda s: s["codec_type"] == "audio").alias("has_audio"),
    )


def frame_times(start: Column, fps: Column, n: Column) -> Column:
    """Times of n frames at a fixed rate."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int"), F.lit(1)) - 1), lambda i: start + i / fps)).otherwise(F.array().cast("array<double>"))


class Adapter(Protocol):
    """What runs outside Spark: takes requests, one row each, and returns rows of a fixed schema. Called through mapInPandas."""

    schema: str

    def __call__(self, batches): ...


class NoResults:
    """An adapter that finds nothing, for a program that is not installed."""

    def __init__(self, schema: str):
        self.schema = schema

    def __call__(self, batches):
        for batch in batches:
            yield batch.iloc[:0].reindex(columns=[c.split()[0] for c in self.schema.split(", ")])


def adapted(requests: DataFrame, adapter: Adapter) -> DataFrame:
    return requests.mapInPandas(adapter, adapter.schema)
