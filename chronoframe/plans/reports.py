"""Whole reports over the driver tables: users of `events` are recordings, their purchases frames, `conversations` the transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.functions import scalar
from chronoframe.operators import captions, intervals, report
from chronoframe.plans.registry import query
from chronoframe.plans.timeline import _ISL, _SCENES, _SPOKEN, by_recording, ranged_scenes, segments, spoken, table, windows
from chronoframe.sources.shared import written

#: A recording's microseconds become seconds; so long a time is worth a quarter of a second.
UNIT = 4e9

#: The rows that the heads of reports are made from; values are derived from ids and times, so that every kind of line occurs.
_HEADS = f"""WITH {_ISL}, {_SCENES}, {_SPOKEN}, ns AS (SELECT video_id, count(*) AS n_segments FROM sp GROUP BY 1), nf AS (SELECT video_id, count(*) AS n_frames FROM sc GROUP BY 1),
nw AS (SELECT video_id, sum(e - s)::BIGINT AS covered, string_agg((round_even((s - lo) / {UNIT}::DOUBLE, 0)::BIGINT // 60) || ':' || lpad((round_even((s - lo) / {UNIT}::DOUBLE, 0)::BIGINT % 60)::VARCHAR, 2, '0') || '-' || (round_even((e - lo) / {UNIT}::DOUBLE, 0)::BIGINT // 60) || ':' || lpad((round_even((e - lo) / {UNIT}::DOUBLE, 0)::BIGINT % 60)::VARCHAR, 2, '0'), ', ' ORDER BY win) AS listed FROM win JOIN rng USING (video_id) WHERE n > 1 GROUP BY 1),
h0 AS (SELECT video_id AS v, (hi - lo) / {UNIT}::DOUBLE AS d, coalesce(n_frames, 0) AS nf, coalesce(n_segments, 0) AS ns, covered, listed FROM rng LEFT JOIN nf USING (video_id) LEFT JOIN ns USING (video_id) LEFT JOIN nw USING (video_id)),
h1 AS (SELECT *, CASE WHEN v % 3 = 1 THEN d / 4 END AS st, CASE WHEN v % 6 = 1 THEN d / 2 END AS en, CASE v % 4 WHEN 0 THEN 'two-pass' WHEN 1 THEN 'scenes' ELSE 'fps' END AS mode, v % 5 > 0 AS ocr, CASE WHEN v % 10 <> 3 THEN nf // 2 END AS nt, CASE WHEN v % 7 = 2 THEN 0 ELSE nf END AS nsc FROM h0),
h AS (SELECT *, st IS NOT NULL OR en IS NOT NULL AS f, coalesce(st, 0) AS lo, coalesce(en, d) AS hi, CASE WHEN v % 4 = 0 OR v % 8 = 1 THEN listed || ' (covering ' || round_even(covered / {UNIT}::DOUBLE, 0)::BIGINT || 's of ' || round_even(CASE WHEN st IS NOT NULL OR en IS NOT NULL THEN greatest(0, coalesce(en, d) - coalesce(st, 0)) ELSE d END, 0)::BIGINT || 's)' END AS w FROM h1)"""
_CLOCK = "CASE WHEN round_even({0}, 0) >= 3600 THEN printf('%d:%02d:%02d', round_even({0}, 0)::BIGINT // 3600, round_even({0}, 0)::BIGINT % 3600 // 60, round_even({0}, 0)::BIGINT % 60) ELSE printf('%02d:%02d', round_even({0}, 0)::BIGINT // 60, round_even({0}, 0)::BIGINT % 60) END"
_AT, _LO, _HI = _CLOCK.format("d"), _CLOCK.format("lo"), _CLOCK.format("hi")


def _sql_lines(section: int, lines: list[str], source: str = "h") -> str:
    return f"SELECT v AS video_id, {section} AS section, (unnest(range(len(y))))::BIGINT AS idx, unnest(y) AS line FROM (SELECT v, list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL) AS y FROM {source})"


_HEAD_LINES = [
    "'# chronoframe: video report'", "''", "'- **Source:** /videos/' || v || '.mp4'", "CASE WHEN v % 9 = 4 THEN '- **Audio source:** `/sound/' || v || '.mp3` (separate file via `--audio`)' END", "CASE WHEN v % 2 = 0 THEN '- **Title:** recording ' || v END", "CASE WHEN v % 4 = 2 THEN '- **Uploader:** user ' || v END",
    f"'- **Duration:** ' || {_AT} || printf(' (%.1fs)', d)", f"CASE WHEN f THEN '- **Focus range:** ' || {_LO} || ' → ' || {_HI} || printf(' (%.1fs)', greatest(0, hi - lo)) END",
    "CASE WHEN v % 5 <> 1 THEN '- **Resolution:** 640x360 (' || CASE WHEN v % 2 = 0 THEN 'h264' ELSE 'unknown codec' END || ')' END",
    """'- **Frames:** ' || CASE WHEN mode = 'two-pass' THEN nf || ' extracted via two-pass (' || nf // 3 || ' in speech windows, ' || nf - nf // 3 || ' outside; speech share 70%' || CASE WHEN nsc > 0 THEN ', ' || nsc || ' scenes informing pick' ELSE '' END || ', max 80, ' || CASE WHEN f THEN 'focused' ELSE 'full' END || ' mode)'
    WHEN mode = 'scenes' THEN nsc || ' scenes detected, ' || nf || ' extracted at scene midpoints (max 80, threshold 27.0, ' || CASE WHEN f THEN 'focused' ELSE 'full' END || ' mode)' || CASE WHEN w IS NULL THEN ' — two-pass requested but no transcript with timing was available' ELSE '' END
    ELSE nf || ' @ ' || printf('%.3f', nf / d) || ' fps, ' || CASE WHEN f THEN 'focused' ELSE 'full' END || ' mode (budget ' || nf + 1 || ', max 80)' || CASE WHEN nsc = 0 AND v % 8 <> 2 THEN ' — scene-detect found no cuts, fell back to fps' ELSE '' END END""",
    "'- **Frame size:** 512px wide' || CASE WHEN v % 3 = 0 AND nf > 0 THEN ' (' || nf || ' text-heavy frames upscaled to 1024px)' ELSE '' END",
    "CASE WHEN NOT ocr THEN '- **OCR:** disabled (`--no-ocr`)' WHEN nt IS NULL THEN '- **OCR:** unavailable (pytesseract or tesseract binary missing — see stderr)' ELSE '- **OCR:** ' || nt || '/' || nf || ' frames had detected text (lang=spa+eng)' END",
    "CASE WHEN ns > 0 THEN '- **Transcript:** ' || ns || ' segments' || CASE WHEN f THEN ' in range' ELSE '' END || ' (via ' || CASE WHEN v % 2 = 1 THEN 'whisper (groq)' ELSE 'captions' END || ')' ELSE '- **Transcript:** none available' END", "CASE WHEN ns > 0 THEN '- **Speech windows:** ' || w END",
    "CASE WHEN NOT f AND d > 600 THEN '' END", "CASE WHEN NOT f AND d > 600 THEN '> **Warning:** This is a ' || floor(d / 60)::BIGINT || '-minute video. Frame coverage is sparse at this length — accuracy degrades noticeably on anything over 10 minutes. For better results, re-run with `--start HH:MM:SS --end HH:MM:SS` to zoom into a specific section.' END",
]


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = by_recording(segments(spark, sf_dir)), spoken(spark, sf_dir)
    v, d, n = F.col("video_id"), F.col("duration"), F.col("n_frames")
    null = F.lit(None).cast("string")
    w = windows(s, F.count_if(F.col("event_type") == "purchase").alias("n_frames"))
    several = lambda x: F.when(F.col("n") > 1, x)
    r = w.groupBy("video_id").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.sum("n_frames").alias("n_frames"), F.collect_list(several(F.struct("win", "start", "end"))).alias("ws"), (F.sum(several(F.col("end") - F.col("start"))) / UNIT).alias("covered"))
    at = lambda x: (x - F.col("lo")) / UNIT
    ws = F.transform(F.array_sort("ws"), lambda x: F.struct(at(x["start"]).alias("start"), at(x["end"]).alias("end")))
    h = r.select("video_id", at(F.col("hi")).alias("duration"), "n_frames", F.when(F.size("ws") > 0, ws).alias("ws"), "covered")
    h = h.join(c.groupBy("video_id").agg(F.count("*").alias("n_segments")), "video_id", "left").fillna(0, ["n_segments"])
    h = h.withColumns({"start": F.when(v % 3 == 1, d / 4), "end": F.when(v % 6 == 1, d / 2), "mode": F.when(v % 4 == 0, "two-pass").when(v % 4 == 1, "scenes").otherwise("fps")})
    focused = F.col("start").isNotNull() | F.col("end").isNotNull()
    full = F.when(focused, F.greatest(F.lit(0.0), F.coalesce("end", d) - F.coalesce("start", F.lit(0.0)))).otherwise(d)
    return h.select(
        "video_id", F.concat(F.lit("/videos/"), v.cast("string"), F.lit(".mp4")).alias("source"), F.when(v % 9 == 4, F.concat(F.lit("/sound/"), v.cast("string"), F.lit(".mp3"))).alias("audio_path"), F.when(v % 2 == 0, F.concat(F.lit("recording "), v.cast("string"))).alias("title"), F.when(v % 4 == 2, F.concat(F.lit("user "), v.cast("string"))).alias("uploader"),
        "duration", "start", "end", F.when(v % 5 != 1, 640).alias("width"), F.when(v % 5 != 1, 360).alias("height"), F.when(v % 2 == 0, "h264").alias("codec"), "mode", "n_frames", F.floor(n / 3).alias("n_speech"), F.when(v % 7 == 2, 0).otherwise(n).alias("n_scenes"), F.lit(True).alias("two_pass"), F.lit(True).alias("speech"), F.lit(True).alias("scene_detect"),
        (v % 8 == 2).alias("fixed_rate"), (n / d).alias("fps"), (n + 1).alias("target"), F.lit(80).alias("max_frames"), F.lit(27.0).alias("threshold"), F.lit(512).alias("resolution"), F.when(v % 3 == 0, n).otherwise(0).alias("n_large"), (v % 5 > 0).alias("ocr"), F.when(v % 10 != 3, F.floor(n / 2)).alias("n_text"), "n_segments",
        F.when(v % 2 == 1, "whisper (groq)").otherwise(null).alias("transcript_source"), F.when((v % 4 == 0) | (v % 8 == 1), F.when(F.col("ws").isNotNull(), report.window_summary(F.col("ws"), F.col("covered"), full))).alias("windows"), F.concat(F.lit("/work/"), v.cast("string")).alias("work"), (v % 2 == 0).alias("has_captions"),
    )


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = by_recording(segments(spark, sf_dir))
    f = intervals.tagged(intervals.with_midpoints(ranged_scenes(s)), windows(s).where("n > 1"), "midpoint")
    return f.select("video_id", F.col("scene_no").alias("idx"), F.format_string("/work/frames/frame_%d.jpg", "scene_no").alias("path"), scalar.exact_round(2)((F.col("midpoint") - F.col("lo")) / UNIT).alias("timestamp_seconds"), "tag", F.when(F.col("scene_no") % 2 == 0, F.concat(F.lit(" seen\n\t"), F.col("scene_no").cast("string"), F.lit(" "))).alias("text"))


def whole_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = written(_heads(spark, sf_dir), "heads")  # a row per recording, which most parts of a report read
    return report.reports(heads, _frames(spark, sf_dir), captions.transcript_lines(spoken(spark, sf_dir)))


@query("report_head", f"{_HEADS} {_sql_lines(0, _HEAD_LINES)}")
def report_head(spark, sf_dir):
    return report.head_lines(_heads(spark, sf_dir))


_FRAME = f"""SELECT video_id, 2, scene_no, '- `/work/frames/frame_' || scene_no || '.jpg` (t=' || {_CLOCK.format('t')} || ')' || CASE WHEN mode = 'two-pass' AND w IS NOT NULL THEN CASE WHEN hit THEN ' [speech]' ELSE ' [silent]' END ELSE '' END || CASE WHEN ocr AND nt IS NOT NULL AND scene_no % 2 = 0 THEN ' — OCR: seen ' || scene_no ELSE '' END
FROM (SELECT sc.video_id, scene_no, printf('%.2f', (mid - rng.lo) / {UNIT}::DOUBLE)::DOUBLE AS t, EXISTS (SELECT 1 FROM win WHERE n > 1 AND win.video_id = sc.video_id AND sc.mid BETWEEN win.s AND win.e) AS hit, h.* FROM sc JOIN rng USING (video_id) JOIN h ON v = sc.video_id)"""
_SAID = """SELECT video_id, 4, seq, CASE WHEN coalesce(speaker, '') <> '' THEN '[' || speaker || '] (' || (trunc(s)::BIGINT // 60) || ':' || lpad((trunc(s)::BIGINT % 60)::VARCHAR, 2, '0') || '-' || (trunc(e)::BIGINT // 60) || ':' || lpad((trunc(e)::BIGINT % 60)::VARCHAR, 2, '0') || ') ' || text
ELSE '[' || lpad((trunc(s)::BIGINT // 60)::VARCHAR, 2, '0') || ':' || lpad((trunc(s)::BIGINT % 60)::VARCHAR, 2, '0') || '] ' || text END FROM sp WHERE video_id IN (SELECT v FROM h)"""
_TITLES = [
    "''", "'## Frames'", "''", "'Frames live at: `/work/' || v || '/frames`'", "''", "'**Read each frame path below with the Read tool to view the image.** Frames are in chronological order; `t=MM:SS` is the absolute timestamp in the source video.'", "CASE WHEN ocr AND nt IS NOT NULL THEN '' END",
    "CASE WHEN ocr AND nt IS NOT NULL THEN 'Each frame line includes any text detected by OCR (Spanish + English). Use it to correlate visuals with on-screen captions, slides, UI text, etc. Frames where OCR found significant text were re-extracted at 1024px so the text is legible when you Read them.' END", "''",
]
_OPENED = [
    "''", "'## Transcript'", "''", f"CASE WHEN ns > 0 THEN '_Source: ' || CASE WHEN v % 2 = 1 THEN 'whisper (groq)' ELSE 'captions' END || '.' || CASE WHEN f THEN ' Filtered to ' || {_LO} || ' → ' || {_HI} || ':_' ELSE '_' END END", "CASE WHEN ns > 0 THEN '' END", "CASE WHEN ns > 0 THEN '```' END",
    f"CASE WHEN ns = 0 THEN CASE WHEN f AND v % 2 = 0 THEN '_No transcript lines fell inside ' || {_LO} || ' → ' || {_HI} || '._' ELSE '_No transcript available — proceed with frames only. Captions were missing and the speech fallback was unavailable (no API key set, or `--no-whisper` was used)._' END END",
]
_CLOSED = ["CASE WHEN ns > 0 THEN '```' END", "''", "'---'", "'_Work dir: `/work/' || v || '` — delete when done._'"]
_REPORT = " UNION ALL ".join([_sql_lines(0, _HEAD_LINES), _sql_lines(1, _TITLES), _FRAME, _sql_lines(3, _OPENED), _SAID, _sql_lines(5, _CLOSED)])


@query("report_text", f"{_HEADS} {_REPORT}")
def report_text(spark, sf_dir):
    return whole_reports(spark, sf_dir)


@query("native_report", f"WITH h AS (SELECT page_id AS v, url AS u, CASE WHEN coalesce(regexp_replace(regexp_replace(lower(regexp_extract(url, '(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), '^m\\.', '') IN ('youtube.com', 'youtu.be'), false) THEN 'native YouTube URL (no download)' WHEN coalesce(regexp_matches(url, '(?i)^https?://[^/?#]+'), false) THEN 'yt-dlp download → Gemini Files API upload' ELSE 'local file → Gemini Files API upload' END AS m, html FROM pages) " + _sql_lines(0, ["'# chronoframe: video report (Gemini backend)'", "''", "'- **Source:** ' || u", "'- **Backend:** Gemini (small)'", "'- **Mode:** ' || m", "'- **Question:** why ' || v || '?'", "''", "'## Gemini response'", "''", "html", "''", "'---'", "'_Work dir: `/work/' || v || '` — delete when done._'"]))
def native_report(spark, sf_dir):
    v = F.col("page_id").cast("string")
    d = table(spark, sf_dir, "pages").select(F.col("page_id").alias("video_id"), F.col("url").alias("source"), F.lit("Gemini").alias("backend"), F.lit("small").alias("model"), F.concat(F.lit("why "), v, F.lit("?")).alias("question"), F.col("html").alias("response"), F.concat(F.lit("/work/"), v).alias("work"))
    return report.native_reports(d)


@query("router_report", f"{_HEADS} " + _sql_lines(0, [
    "'# chronoframe: video report (OpenRouter backend)'", "''", "'- **Source:** /videos/' || v || '.mp4'", "CASE WHEN v % 2 = 0 THEN '- **Title:** recording ' || v END", "CASE WHEN v % 4 = 2 THEN '- **Uploader:** user ' || v END", f"'- **Duration:** ' || {_AT} || printf(' (%.1fs)', d)", f"CASE WHEN f THEN '- **Focus:** ' || {_LO} || '–' || {_HI} END",
    "'- **Vision model:** m' || v", f"'- **Frames:** ' || nf || ' @ ' || printf('%.3f', nf / d) || ' fps (' || CASE WHEN f THEN {_LO} || '–' || {_HI} ELSE 'full' END || ')'", "CASE WHEN ns > 0 THEN '- **Transcript:** ' || ns || ' segments (via captions)' ELSE '- **Transcript:** none' END", "'- **Question:** why?'", "''", "'## OpenRouter response'", "''", "'answer ' || v", "''", "'---'", "'_Work dir: `/work/' || v || '` — delete when done._'",
]))
def router_report(spark, sf_dir):
    v = F.col("video_id").cast("string")
    d = _heads(spark, sf_dir).withColumns({"backend": F.lit("OpenRouter"), "model": F.concat(F.lit("m"), v), "question": F.lit("why?"), "response": F.concat(F.lit("answer "), v), "transcript_source": F.lit("captions")})
    return report.router_reports(d)
