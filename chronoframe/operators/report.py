"""Reports: ordered lines and JSON entries of each recording, a row each, so that no row grows with its recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.functions.scalar import collapse_space, exact_round, format_clock, format_time, half_even, is_url, is_video_host
from chronoframe.operators.budget import SPEECH_SHARE
from chronoframe.operators.recognition import LARGE_WIDTH


def window_summary(windows: Column, covered: Column | None = None, full: Column | None = None) -> Column:
    """M:SS-M:SS, ... of an array of (start, end) in seconds, '(none)' if empty, with the share covered where `full` is positive."""
    listed = F.array_join(F.transform(windows, lambda w: F.concat(format_clock(w["start"]), F.lit("-"), format_clock(w["end"]))), ", ")
    out = F.when(F.coalesce(F.size(windows), F.lit(0)) < 1, F.lit("(none)")).otherwise(listed)
    if covered is None or full is None:
        return out
    tail = F.concat(F.lit(" (covering "), half_even(covered).cast("string"), F.lit("s of "), half_even(full).cast("string"), F.lit("s)"))
    return F.when((F.size(windows) > 0) & (full > 0) & covered.isNotNull(), F.concat(out, tail)).otherwise(out)


#: The wording of reports, in the order in which they show it. {} stand for values.
VIEW = "**Read each frame path below with the Read tool to view the image.** Frames are in chronological order; `t=MM:SS` is the absolute timestamp in the source video."
WITH_TEXT = "Each frame line includes any text detected by OCR ({}). Use it to correlate visuals with on-screen captions, slides, UI text, etc. Frames where OCR found significant text were re-extracted at {}px so the text is legible when you Read them."
LONG = "> **Warning:** This is a {}-minute video. Frame coverage is sparse at this length — accuracy degrades noticeably on anything over 10 minutes. For better results, re-run with `--start HH:MM:SS --end HH:MM:SS` to zoom into a specific section."
NO_SPEECH = " — two-pass requested but no transcript with timing was available"
NO_CUTS = " — scene-detect found no cuts, fell back to fps"
NO_READER = "unavailable (pytesseract or tesseract binary missing — see stderr)"
NO_TRANSCRIPT = "_No transcript available — proceed with frames only. Captions were missing and the speech fallback was unavailable (no API key set, or `--no-whisper` was used)._"
NOTHING_INSIDE = "_No transcript lines fell inside {}._"
FOOTER = "_Work dir: `{}` — delete when done._"
#: Sections of a report, in order.
HEAD, FRAMES_TITLE, FRAMES, TRANSCRIPT_TITLE, TRANSCRIPT, END = range(6)


def _text(template: str, *parts: Column) -> Column:
    """The template with its {} replaced by columns; null if any of them is."""
    out: list[Column] = []
    for fixed, part in zip(template.split("{}"), [*parts, None], strict=True):
        out += [F.lit(fixed)] if fixed else []
        out += [part.cast("string")] if part is not None else []
    return F.concat(*out)


def _tenths(x: Column) -> Column:
    return F.format_string("%.1f", exact_round(1)(x.cast("double")))


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def frame_line(path: Column, seconds: Column, tag: Column, text: Column) -> Column:
    shown = collapse_space(F.coalesce(text, F.lit("")))
    return F.concat(F.lit("- `"), path, F.lit("` (t="), format_time(seconds), F.lit(")"), F.coalesce(F.concat(F.lit(" "), tag), F.lit("")), F.when(shown != "", F.concat(F.lit(" — OCR: "), shown)).otherwise(F.lit("")))


def long_warning(duration: Column, focused: Column) -> Column:
    """The hint for whole recordings of over ten minutes, else null."""
    return F.when(~focused & (duration > 600), _text(LONG, F.floor(duration / 60)))


def _listed(d: DataFrame, key: str, section: int, lines: list[Column]) -> DataFrame:
    """key, section, idx, line of the lines that are not null."""
    kept = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return d.select(key, F.lit(section).alias("section"), F.posexplode(kept).alias("idx", "line")).withColumn("idx", F.col("idx").cast("long"))


def _scope() -> tuple[Column, Column, Column]:
    focused = F.col("start").isNotNull() | F.col("end").isNotNull()
    return focused, F.coalesce("start", F.lit(0.0)), F.coalesce("end", "duration")


def head_lines(d: DataFrame, key: str = "video_id", tool: str = "chronoframe") -> DataFrame:
    """key, section, idx, line: the head of a report; idx numbers its lines from 0.

    d: key, source, audio_path, title, uploader, duration, start and end (as asked for), width, height, codec, mode (two-pass, scenes or fps), n_frames, n_speech,
    n_scenes (null: not sought), two_pass, scene_detect, speech (whether these were asked for), fixed_rate (whether a rate was), fps, target, max_frames, threshold,
    resolution, n_large, ocr (whether it was asked for), n_text (null: no reader), n_segments, transcript_source, windows (their summary, null or empty: none).
    """
    c = F.col
    focused, lo, hi = _scope()
    mode = F.when(focused, F.lit("focused")).otherwise(F.lit("full"))
    informed = F.when(c("n_scenes") > 0, _text(", {} scenes informing pick", c("n_scenes"))).otherwise(F.lit(""))
    two_pass = _text("- **Frames:** {} extracted via two-pass ({} in speech windows, {} outside; speech share " + str(int(SPEECH_SHARE * 100)) + "%{}, max {}, {} mode)", c("n_frames"), c("n_speech"), c("n_frames") - c("n_speech"), informed, c("max_frames"), mode)
    no_windows = F.coalesce(_filled("windows"), F.lit("")) == ""
    silent = F.when(c("two_pass") & c("speech") & no_windows, F.lit(NO_SPEECH)).otherwise(F.lit(""))
    scenes = _text("- **Frames:** {} scenes detected, {} extracted at scene midpoints (max {}, threshold {}, {} mode){}", c("n_scenes"), c("n_frames"), c("max_frames"), c("threshold"), mode, silent)
    uncut = F.when(c("scene_detect") & ~c("fixed_rate") & (F.coalesce("n_scenes", F.lit(-1)) == 0), F.lit(NO_CUTS)).otherwise(F.lit(""))
    rate = _text("- **Frames:** {} @ {} fps, {} mode (budget {}, max {}){}", c("n_frames"), F.format_string("%.3f", exact_round(3)(c("fps").cast("double"))), mode, c("target"), c("max_frames"), uncut)
    spoken = c("n_segments") > 0
    lines = [
        F.lit(f"# {tool}: video report"), F.lit(""),
        _text("- **Source:** {}", c("source")), _text("- **Audio source:** `{}` (separate file via `--audio`)", _filled("audio_path")), _text("- **Title:** {}", _filled("title")), _text("- **Uploader:** {}", _filled("uploader")),
        _text("- **Duration:** {} ({}s)", format_time(c("duration")), _tenths(c("duration"))),
        F.when(focused, _text("- **Focus range:** {} → {} ({}s)", format_time(lo), format_time(hi), _tenths(F.greatest(F.lit(0.0), hi - lo)))),
        F.when((c("width") > 0) & (c("height") > 0), _text("- **Resolution:** {}x{} ({})", c("width"), c("height"), F.coalesce(_filled("codec"), F.lit("unknown codec")))),
        F.when(c("mode") == "two-pass", two_pass).when((c("mode") == "scenes") & c("n_scenes").isNotNull(), scenes).otherwise(rate),
        F.when(c("n_large") > 0, _text("- **Frame size:** {}px wide ({} text-heavy frames upscaled to {}px)", c("resolution"), c("n_large"), F.lit(LARGE_WIDTH))).otherwise(_text("- **Frame size:** {}px wide", c("resolution"))),
        F.when(~c("ocr"), F.lit("- **OCR:** disabled (`--no-ocr`)")).otherwise(F.coalesce(_text("- **OCR:** {}/{} frames had detected text (lang=spa+eng)", c("n_text"), c("n_frames")), F.lit(f"- **OCR:** {NO_READER}"))),
        F.when(spoken, _text("- **Transcript:** {} segments{} (via {})", c("n_segments"), F.when(focused, F.lit(" in range")).otherwise(F.lit("")), F.coalesce(_filled("transcript_source"), F.lit("captions")))).otherwise(F.lit("- **Transcript:** none available")),
        F.when(spoken, _text("- **Speech windows:** {}", _filled("windows"))),
        F.when(~focused & (c("duration") > 600), F.lit("")), long_warning(c("duration"), focused),
    ]
    return _listed(d, key, HEAD, lines)


def reports(d: DataFrame, frames: DataFrame, transcript: DataFrame, key: str = "video_id", tool: str = "chronoframe") -> DataFrame:
    """key, section, idx, line: whole reports, a row per line; ordered by section and idx they are the text.

    d: as for head_lines, and work (the folder), has_captions. frames: key, idx, path, timestamp_seconds, tag, text. transcript: key, seq, line. Rows of recordings that d does not
    have are left out. Tags show where the mode is two-pass and there are windows.
    """
    focused, lo, hi = _scope()
    part = _text("{} → {}", format_time(lo), format_time(hi))
    read = F.col("ocr") & F.col("n_text").isNotNull()
    titles = _listed(d, key, FRAMES_TITLE, [F.lit(""), F.lit("## Frames"), F.lit(""), _text("Frames live at: `{}/frames`", F.col("work")), F.lit(""), F.lit(VIEW), F.when(read, F.lit("")), F.when(read, _text(WITH_TEXT, F.lit("Spanish + English"), F.lit(LARGE_WIDTH))), F.lit("")])
    shown = (F.col("mode") == "two-pass") & (F.coalesce(_filled("windows"), F.lit("")) != "")
    own = frames.join(d.select(key, shown.alias("_shown"), read.alias("_read")), key)
    listed = own.select(key, F.lit(FRAMES).alias("section"), F.col("idx").cast("long").alias("idx"), frame_line(F.col("path"), F.col("timestamp_seconds"), F.when(F.col("_shown"), F.col("tag")), F.when(F.col("_read"), F.col("text"))).alias("line"))
    said = F.col("n_segments") > 0
    source = F.coalesce(_filled("transcript_source"), F.lit("captions"))
    label = F.when(focused, _text("_Source: {}. Filtered to {}:_", source, part)).otherwise(_text("_Source: {}._", source))
    none = F.when(~said, F.when(focused & F.col("has_captions"), _text(NOTHING_INSIDE, part)).otherwise(F.lit(NO_TRANSCRIPT)))
    opened = _listed(d, key, TRANSCRIPT_TITLE, [F.lit(""), F.lit("## Transcript"), F.lit(""), F.when(said, label), F.when(said, F.lit("")), F.when(said, F.lit("```")), none])
    lines = transcript.join(d.where(said).select(key), key, "left_semi").select(key, F.lit(TRANSCRIPT).alias("section"), F.col("seq").cast("long").alias("idx"), "line")
    closed = _listed(d, key, END, [F.when(said, F.lit("```")), F.lit(""), F.lit("---"), _text(FOOTER, F.col("work"))])
    return head_lines(d, key, tool).unionByName(titles).unionByName(listed).unionByName(opened).unionByName(lines).unionByName(closed)


def native_mode(source: Column, backend: Column) -> Column:
    """How a recording reaches a model that takes whole videos."""
    return F.when(is_video_host(source), F.lit("native YouTube URL (no download)")).when(is_url(source), _text("yt-dlp download → {} Files API upload", backend)).otherwise(_text("local file → {} Files API upload", backend))


def native_reports(d: DataFrame, key: str = "video_id", tool: str = "chronoframe") -> DataFrame:
    """key, section, idx, line of reports on answers about whole videos. d: key, source, backend, model, question, response, work."""
    c = F.col
    lines = [
        _text(f"# {tool}: video report ({{}} backend)", c("backend")), F.lit(""), _text("- **Source:** {}", c("source")), _text("- **Backend:** {} ({})", c("backend"), c("model")), _text("- **Mode:** {}", native_mode(c("source"), c("backend"))), _text("- **Question:** {}", c("question")),
        F.lit(""), _text("## {} response", c("backend")), F.lit(""), c("response"), F.lit(""), F.lit("---"), _text(FOOTER, c("work")),
    ]
    return _listed(d, key, HEAD, lines)


def router_reports(d: DataFrame, key: str = "video_id", tool: str = "chronoframe") -> DataFrame:
    """key, section, idx, line of reports on answers about frames and a transcript.

    d: key, source, backend, title, uploader, duration, start, end, model, n_frames, fps, n_segments, transcript_source, question, response, work.
    """
    c = F.col
    focused, lo, hi = _scope()
    scope = F.when(focused, _text("{}–{}", format_time(lo), format_time(hi))).otherwise(F.lit("full"))
    lines = [
        _text(f"# {tool}: video report ({{}} backend)", c("backend")), F.lit(""), _text("- **Source:** {}", c("source")), _text("- **Title:** {}", _filled("title")), _text("- **Uploader:** {}", _filled("uploader")),
        _text("- **Duration:** {} ({}s)", format_time(c("duration")), _tenths(c("duration"))), F.when(focused, _text("- **Focus:** {}", scope)), _text("- **Vision model:** {}", c("model")),
        _text("- **Frames:** {} @ {} fps ({})", c("n_frames"), F.format_string("%.3f", exact_round(3)(c("fps").cast("double"))), scope),
        F.when(c("n_segments") > 0, _text("- **Transcript:** {} segments (via {})", c("n_segments"), c("transcript_source"))).otherwise(F.lit("- **Transcript:** none")), _text("- **Question:** {}", c("question")),
        F.lit(""), _text("## {} response", c("backend")), F.lit(""), c("response"), F.lit(""), F.lit("---"), _text(FOOTER, c("work")),
    ]
    return _listed(d, key, HEAD, lines)


def text_map(texts: DataFrame, key: str = "video_id") -> DataFrame:
    """key, path, json: the entry path -> text as a JSON object, one row per row of texts; written out with partitionBy(key), a recording is a folder.

    Repeated paths keep all their rows; a null path counts as an empty one.
    """
    path = F.coalesce("path", F.lit(""))
    return texts.select(key, path.alias("path"), F.to_json(F.create_map(path, "text")).alias("json"))


def text_map_lines(texts: DataFrame, key: str = "video_id") -> DataFrame:
    """key, at, line: one indented JSON object path -> text per recording, in the order of idx; ties come in any order.

    texts: key, idx, path, text. Null paths count as empty ones, a null text is null. A line for each entry, the brackets with the first and
    the last. A recording's lines are in one task, as a window leaves them.
    """
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)
    w = Window.partitionBy(key).orderBy("idx")
    at, last = F.row_number().over(w), F.lead(F.lit(1)).over(w).isNull()
    entry = F.concat(F.lit("  "), quoted(F.coalesce("path", F.lit(""))), F.lit(": "), quoted(F.col("text")))
    line = F.concat(F.when(F.col("at") == 1, F.lit("{\n")).otherwise(F.lit("")), entry, F.when(F.col("_last"), F.lit("\n}")).otherwise(F.lit(",")))
    return texts.withColumns({"at": at, "_last": last}).select(key, "at", line.alias("line"))


def scene_report(scenes: DataFrame, key: str = "video_id") -> DataFrame:
    """key, scene_no, json: each scene with its midpoint, one row per scene."""
    each = F.struct("scene_no", "start", "end", ((F.col("start") + F.col("end")) / 2).alias("midpoint"))
    return scenes.select(key, "scene_no", F.to_json(each).alias("json"))


def chat_payload(frames: DataFrame, prompts: DataFrame, key: str = "video_id") -> DataFrame:
    """key, json: an ordered list of parts: preamble with the number of requested frames, one image per loaded frame, question.

    frames: key, idx, content BINARY (null where loading failed). prompts: key, question, transcript. A recording without a loaded frame has no row.
    """
    part = lambda kind, text, url: F.struct(F.lit(kind).alias("type"), text.alias("text"), url.alias("image_url"))
    null = F.lit(None).cast("string")
    image = part("image_url", null, F.concat(F.lit("data:image/jpeg;base64,"), F.translate(F.base64("content"), "\r\n", "")))
    images = frames.groupBy(key).agg(F.count("*").alias("asked"), F.transform(F.sort_array(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("idx", image.alias("part"))))), lambda x: x["part"]).alias("images"))
    d = images.where(F.size("images") > 0).join(prompts, key)
    preamble = F.concat(F.col("asked").cast("string"), F.lit(" frames in order of time."), F.when(F.coalesce("transcript", F.lit("")) != "", F.concat(F.lit(" Transcript: "), F.col("transcript"))).otherwise(F.lit("")))
    parts = F.concat(F.array(part("text", preamble, null)), F.col("images"), F.array(part("text", F.col("question"), null)))
    return d.select(key, F.to_json(parts).alias("json"))
