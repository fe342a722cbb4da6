"""Queries that write files of the driver tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import report
from chronoframe.plans.registry import query
from chronoframe.plans.reports import _HEADS, _REPORT, whole_reports
from chronoframe.plans.timeline import table
from chronoframe.sources import files, media
from chronoframe.sources.shared import new_path

_TEXTS = "SELECT conv_id::VARCHAR AS video_id, conv_id || '.vtt' AS name, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) || chr(10) AS value FROM conversations GROUP BY conv_id"


def _caption_folder(spark, sf_dir) -> str:
    """A file per conversation, each line with bytes that are no character: two that never occur, and one cut short."""
    c = table(spark, sf_dir, "conversations")
    broken = F.concat(F.unhex(F.lit("FFC0")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("E282")))
    path = new_path(spark, "captions")
    files.save_files(c.select(F.col("conv_id").alias("video_id"), "turn", broken.alias("line")), path, ["turn"], extension="vtt")
    return path


@query("caption_source", _TEXTS)
def caption_source(spark, sf_dir):
    """Through the data source."""
    return files.read_captions(spark, _caption_folder(spark, sf_dir), by="stem")


@query("caption_binary", "SELECT name, value FROM (" + _TEXTS + ")")
def caption_binary(spark, sf_dir):
    """Through Spark's reader of binary files."""
    return media.caption_files(spark, f"{_caption_folder(spark, sf_dir)}/*/*.vtt").select("name", "value")


@query("report_files", f"{_HEADS} SELECT video_id::VARCHAR AS video_id, string_agg(line, chr(10) ORDER BY section, idx) || chr(10) AS value FROM ({_REPORT}) GROUP BY 1")
def report_files(spark, sf_dir):
    path = new_path(spark, "reports")
    files.save_files(whole_reports(spark, sf_dir), path, ["section", "idx"])
    return files.whole_files(spark, f"{path}/*/*.md")


@query("text_files", r"""WITH q AS (SELECT lang AS video_id, doc_id, to_json(doc_id::VARCHAR)::VARCHAR || ': ' || to_json(text)::VARCHAR AS entry FROM documents WHERE lang IS NOT NULL)
SELECT video_id, '{' || chr(10) || '  ' || string_agg(entry, ',' || chr(10) || '  ' ORDER BY doc_id) || chr(10) || '}' || chr(10) AS value FROM q GROUP BY 1""")
def text_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("video_id"), F.col("doc_id").alias("idx"), F.col("doc_id").cast("string").alias("path"), "text")
    path = new_path(spark, "texts")
    files.save_files(report.text_map_lines(d), path, ["at"], extension="json", together=True)
    return files.whole_files(spark, f"{path}/*/*.json", large=True)


@query("chat_parts", """WITH d AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, coalesce(text, '') AS text FROM conversations), n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 3 <> 1) AS loaded FROM d GROUP BY 1),
p AS (SELECT conv_id, 0 AS a, 0 AS k, 'text' AS type, n || ' frames in order of time. Transcript: said ' || conv_id AS content FROM n UNION ALL
SELECT conv_id, 1, k, 'image_url', 'data:image/jpeg;base64,' || to_base64(encode(text || chr(10))) FROM d WHERE turn % 3 <> 1 UNION ALL SELECT conv_id, 2, 0, 'text', 'why ' || conv_id || '?' FROM n)
SELECT conv_id::VARCHAR AS video_id, (row_number() OVER (PARTITION BY conv_id ORDER BY a, k) - 1)::INT AS at, type, content FROM p WHERE conv_id IN (SELECT conv_id FROM n WHERE loaded > 0)""")
def chat_parts(spark, sf_dir):
    """A request to a vision model per conversation: its turns are written as files and read as images, every third of which is missing; a row per part."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    path = new_path(spark, "images")
    named = c.select(F.concat_ws("-", "video_id", "turn").alias("video_id"), "turn", F.col("text").alias("line")).where(F.col("turn") % 3 != 1)
    files.save_files(named, path, ["turn"], extension="jpg")
    images = spark.read.format("binaryFile").load(f"{path}/*/*.jpg").select(F.substring_index(F.element_at(F.split("path", "/"), -1), ".", 1).alias("name"), "content")
    frames = c.withColumn("name", F.concat_ws("-", "video_id", "turn")).join(images, "name", "left").select("video_id", F.col("turn").alias("idx"), "content")
    v = F.col("video_id")
    prompts = c.select("video_id").distinct().select("video_id", F.concat(F.lit("why "), v, F.lit("?")).alias("question"), F.concat(F.lit("said "), v).alias("transcript"))
    parts = F.from_json("json", "array<struct<type:string,text:string,image_url:string>>")
    d = report.chat_payload(frames, prompts).select("video_id", F.posexplode(parts).alias("at", "p"))
    return d.select("video_id", "at", "p.type", F.coalesce("p.text", "p.image_url").alias("content"))
