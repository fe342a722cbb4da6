"""Captions: WebVTT parsing, collapse of rolling lines, transcript text, speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.functions.scalar import cue_clock, cue_stamp, exact_round, strip, strip_tags

#: Fixed pattern: hours are required, milliseconds follow a point or a comma, settings may follow.
CUE = r"^(\d{2}):(\d{2}):(\d{2})[.,](\d{3})\s+-->\s+(\d{2}):(\d{2}):(\d{2})[.,](\d{3})"
_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"


def collapse_runs(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """key, seq, start, end, text: a segment joins the one before if it repeats its text or continues it after a space.

    A run has its first segment's start and seq and its last one's end and text. What counts is the row before, since a run's text is
    always its last row's.
    """
    w = Window.partitionBy(key).orderBy("seq")
    before = F.lag("text").over(w)
    new = before.isNull() | ~((F.col("text") == before) | F.startswith(F.col("text"), F.concat(before, F.lit(" "))))
    marked = segments.withColumn("_new", new.cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "_run").agg(F.min("seq").alias("first_seq"), F.min_by("start", "seq").alias("start"), F.max_by("end", "seq").alias("end"), F.max_by("text", "seq").alias("text")).select(
        key, F.col("first_seq").alias("seq"), "start", "end", "text"
    )


def _millis(line: Column, first: int) -> Column:
    part = lambda i: F.regexp_extract(line, CUE, i).cast("long")
    return ((part(first) * 60 + part(first + 1)) * 60 + part(first + 2)) * 1000 + part(first + 3)


def parse_cues(files: DataFrame, key: str = "video_id", value: str = "value") -> DataFrame:
    """key, seq, start_ms, end_ms, text of the WebVTT texts, one row per cue with text, before any collapse.

    Lines are grouped into blocks between blank lines; a block's first cue line opens the cue, all lines after it are its
    text, without tags, joined by spaces. Blocks without a cue line or without text are dropped.
    """
    lines = files.select(key, F.posexplode(F.split(F.col(value), _BREAK, -1)).alias("at", "line"))
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("block", F.sum((strip(F.col("line")) == "").cast("int")).over(w))
    cue = F.when(F.col("line").rlike(CUE), F.col("at"))
    lines = lines.withColumn("head", F.min(cue).over(Window.partitionBy(key, "block"))).where("head is not null and at >= head")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("at") > F.col("head")) & (strip_tags(F.col("line")) != ""), F.struct("at", strip_tags(F.col("line")).alias("t"))))), lambda x: x["t"]), " ")
    blocks = lines.groupBy(key, "head").agg(F.max(F.when(F.col("at") == F.col("head"), F.col("line"))).alias("cue"), text.alias("text")).where("text <> ''")
    return blocks.select(key, F.col("head").cast("long").alias("seq"), _millis(F.col("cue"), 1).alias("start_ms"), _millis(F.col("cue"), 5).alias("end_ms"), "text")


def parse_vtt(files: DataFrame, key: str = "video_id", value: str = "value") -> DataFrame:
    """key, seq, start, end (seconds, two decimals) and text of WebVTT texts, rolling lines collapsed."""
    two = exact_round(2)
    cues = parse_cues(files, key, value)
    return collapse_runs(cues.select(key, "seq", two(F.col("start_ms") / 1000).alias("start"), two(F.col("end_ms") / 1000).alias("end"), "text"), key)


def transcript_line(start: Column, end: Column, text: Column, speaker: Column) -> Column:
    named = speaker.isNotNull() & (speaker != "")
    return F.when(named, F.concat(F.lit("["), speaker, F.lit("] ("), cue_clock(start), F.lit("-"), cue_clock(end), F.lit(") "), text)).otherwise(F.concat(cue_stamp(start), F.lit(" "), text))


def ordered_text(order: str, line: str, separator: str = "\n") -> Column:
    """Aggregate: the group's lines in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line]), separator)


def transcript_lines(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """key, seq, line: one row per segment; speakers are shown where known."""
    return segments.select(key, "seq", transcript_line(F.col("start"), F.col("end"), F.col("text"), F.col("speaker")).alias("line"))


def transcripts(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """key, transcript: the lines of each recording in one text, for recordings that fit in a row."""
    return transcript_lines(segments, key).groupBy(key).agg(ordered_text("seq", "line").alias("transcript"))


def speakers(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """key, speakers (distinct, sorted, joined), diarised (whether any is known)."""
    return segments.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("speaker")), ", ").alias("speakers"), F.coalesce(F.bool_or(F.col("speaker").isNotNull()), F.lit(False)).alias("diarised"))


def normalised_response(responses: DataFrame, key: str = "video_id", json: str = "json") -> DataFrame:
    """key, seq, start, end, text from speech services' JSON: segments with text, null times as 0; else the whole text as one."""
    schema = "struct<segments:array<struct<start:double,end:double,text:string>>,text:string>"
    d = responses.select(key, F.from_json(json, schema).alias("r"))
    filled = F.filter(F.coalesce("r.segments", F.array().cast("array<struct<start:double,end:double,text:string>>")), lambda s: strip(F.coalesce(s["text"], F.lit(""))) != "")
    whole = F.when(strip(F.coalesce("r.text", F.lit(""))) != "", F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.col("r.text").alias("text")))).otherwise(F.array().cast("array<struct<start:double,end:double,text:string>>"))
    two = exact_round(2)
    rows = d.select(key, F.posexplode(F.when(F.size(filled) > 0, filled).otherwise(whole)).alias("seq", "s"))
    return rows.select(key, F.col("seq").cast("long").alias("seq"), two(F.coalesce("s.start", F.lit(0.0))).alias("start"), two(F.coalesce("s.end", F.lit(0.0))).alias("end"), strip(F.col("s.text")).alias("text"))
