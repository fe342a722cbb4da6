"""What to do with requests: where their recordings come from, and which of them cannot be served, with every reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from chronoframe.functions.scalar import exact_round, is_url, parse_time, strip
from chronoframe.operators.selection import KNOWN

#: Services that answer a question, and the reasons for which requests are turned away.
ASKED = ("gemini", "openrouter")
NO_QUESTION = "--backend {} requires a question"
BOTH_AUDIO = "--audio implies Whisper transcription of that file; cannot combine with --no-whisper"
NO_AUDIO, NO_FILE = "--audio file not found: {}", "File not found: {}"
BAD_TIME = "not a time: {}"
NEGATIVE, REVERSED, PAST = "--start must be non-negative", "--end must be greater than --start", "--start {}s is past end of video ({}s)"
UNKNOWN = "{} is not a known video extension, proceeding anyway"


def _filled(template: str, *parts: Column) -> Column:
    out = F.lit(template.split("{}")[0])
    for part, fixed in zip(parts, template.split("{}")[1:], strict=True):
        out = F.concat(out, part, F.lit(fixed))
    return out


def extension(path: Column) -> Column:
    """The last suffix of a path's name in lower case, with its point; '' if there is none. A name's leading point begins no suffix."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, "([^/]*)$", 1), r"^.+(\.[^.]+)$", 1))


def time_faults(duration: Column, start: Column, end: Column) -> list[Column]:
    """Each a reason or null: a negative start; an end that is given and not after a start that is given; a start past a known duration."""
    one = lambda x: F.format_string("%.1f", exact_round(1)(x.cast("double")))
    return [F.when(start < 0, F.lit(NEGATIVE)), F.when(end <= start, F.lit(REVERSED)), F.when((duration > 0) & (start >= duration), _filled(PAST, one(start), one(duration)))]


def checked(requests: DataFrame, files: DataFrame, key: str = "video_id") -> DataFrame:
    """requests with route (download or local), title, url, start_seconds, end_seconds, warning, and reasons, all of them, in the order of the checks.

    requests: key, source, audio, no_whisper, backend, question, start, end (as texts), duration. files: path of what exists; repeated paths count once. A null
    source is a local file that does not exist.
    """
    there = files.select(F.col("path").alias("_path")).distinct()
    sound = there.select(F.col("_path").alias("_sound"))
    d = requests.join(there, requests["source"] == there["_path"], "left").join(sound, requests["audio"] == sound["_sound"], "left")
    url = F.coalesce(is_url(F.col("source")), F.lit(False))
    d = d.withColumns({"route": F.when(url, F.lit("download")).otherwise(F.lit("local")), "start_seconds": parse_time(F.col("start")), "end_seconds": parse_time(F.col("end"))})
    local = F.col("route") == "local"
    asked = F.col("audio").isNotNull() & (F.col("audio") != "")
    read = lambda c: F.when((strip(F.col(c)) != "") & F.col(f"{c}_seconds").isNull(), _filled(BAD_TIME, F.col(c)))
    # services that take the whole video are asked before times are looked at
    plain = ~F.coalesce(F.col("backend").isin(*ASKED), F.lit(False))
    reasons = [
        F.when(asked & F.coalesce("no_whisper", F.lit(False)), F.lit(BOTH_AUDIO)), F.when(asked & F.col("_sound").isNull(), _filled(NO_AUDIO, F.col("audio"))),
        F.when(~plain & (F.coalesce(strip(F.col("question")), F.lit("")) == ""), _filled(NO_QUESTION, F.col("backend"))), F.when(local & F.col("_path").isNull(), _filled(NO_FILE, F.coalesce("source", F.lit("")))),
        *[read(c) for c in ("start", "end")], *[F.when(plain, x) for x in time_faults(F.col("duration"), F.col("start_seconds"), F.col("end_seconds"))],
    ]
    suffix = extension(F.col("source"))
    known = suffix.isin(*[f".{x}" for x in KNOWN])
    return d.withColumns({
        "title": F.when(local, F.regexp_extract("source", "([^/]*)$", 1)), "url": F.col("source"), "warning": F.when(local & F.col("_path").isNotNull() & ~known, _filled(UNKNOWN, suffix)),
        "reasons": F.filter(F.array(*reasons), lambda x: x.isNotNull()),
    }).drop("_path", "_sound")


def routed(requests: DataFrame, files: DataFrame, key: str = "video_id") -> tuple[DataFrame, DataFrame, Observation]:
    """(accepted, rejected, counts): requests to serve, by route; the others, one row per reason (key, at, reason); and an observation.

    The observation counts requests, accepted ones, downloads and warnings in the run of the first action on `accepted`; it costs no pass of its own.
    """
    d, counts = checked(requests, files, key), Observation("requests")
    good = F.size("reasons") == 0
    seen = d.observe(counts, F.count("*").alias("requests"), F.count_if(good).alias("accepted"), F.count_if(good & (F.col("route") == "download")).alias("downloads"), F.count_if(good & F.col("warning").isNotNull()).alias("warnings"))
    rejected = d.where(~good).select(key, F.posexplode("reasons").alias("at", "reason"))
    return seen.where(good).drop("reasons"), rejected, counts
