"""Queries written as SQL text with the functions of this library, and exact rounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import scalar, sql
from chronoframe.operators import captions
from chronoframe.plans.registry import query
from chronoframe.plans.timeline import _SPOKEN, _vtt, spoken, table

_TIMES = """t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN (event_id % 1200 / 10)::VARCHAR WHEN 1 THEN (event_id % 90) || ':' || (event_id % 600 / 10) WHEN 2 THEN (event_id % 40) || ':' || (event_id % 90) || ':' || (event_id % 60) WHEN 3 THEN '  ' WHEN 4 THEN '1:2:3:4' END AS t,
CASE event_id % 6 WHEN 0 THEN event_id % 1200 / 10 WHEN 1 THEN event_id % 90 * 60 + event_id % 600 / 10 WHEN 2 THEN event_id % 40 * 3600 + event_id % 90 * 60 + event_id % 60 END::DOUBLE AS sec FROM events)"""


@query("sql_functions", f"""WITH {_TIMES}, r AS (SELECT *, round_even(sec, 0)::BIGINT AS n FROM t)
SELECT event_id, sec AS seconds, CASE WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) WHEN n IS NOT NULL THEN printf('%02d:%02d', n // 60, n % 60) END AS shown FROM r""")
def sql_functions(spark, sf_dir):
    sql.register(spark)
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    text = F.when(i % 6 == 0, s(i % 1200 / 10)).when(i % 6 == 1, F.concat_ws(":", s(i % 90), s(i % 600 / 10))).when(i % 6 == 2, F.concat_ws(":", s(i % 40), s(i % 90), s(i % 60))).when(i % 6 == 3, "  ").when(i % 6 == 4, "1:2:3:4")
    events = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    return spark.sql("SELECT event_id, parse_time(t) AS seconds, format_time(parse_time(t)) AS shown FROM {events}", events=events)


@query("sql_predicates", "SELECT page_id, coalesce(regexp_matches(url, '(?i)^https?://[^/?#]+'), false) AS url, length(replace(coalesce(html, ''), ' ', '')) >= 10 AS significant FROM pages")
def sql_predicates(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT page_id, is_url(url) AS url, is_significant(html) AS significant FROM {pages}", pages=table(spark, sf_dir, "pages"))


@query("sql_captions", rf"""WITH {_SPOKEN}, q AS (SELECT video_id, s, e, 3 * row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1 AS seq, trim(regexp_replace('<c>' || regexp_replace(text, '\s+', ' ', 'g') || '</c>', '<[^>]+>', '', 'g')) AS text FROM sp),
b AS (SELECT *, lag(text) OVER (PARTITION BY video_id ORDER BY seq) AS p FROM q WHERE text <> ''), c AS (SELECT *, CASE WHEN p IS NULL OR NOT (text = p OR starts_with(text, p || ' ')) THEN 1 ELSE 0 END AS new FROM b),
r AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT video_id, min(seq)::BIGINT AS seq, arg_min(s, seq) AS "start", arg_max(e, seq) AS "end", arg_max(text, seq) AS text FROM r GROUP BY video_id, run""")
def sql_captions(spark, sf_dir):
    """Caption files parsed by the table function in a lateral join."""
    sql.register(spark)
    return spark.sql("SELECT f.video_id, c.seq, c.start, c.end, c.text FROM {files} f, LATERAL parse_vtt(f.value) c", files=_vtt(spark, sf_dir))


@query("exact_rounding", """WITH v AS (SELECT event_id, value * 1.37 AS a, (event_id * 10 + 5) / 1000::DOUBLE AS b, event_id / 16::DOUBLE AS c, -value / 7 AS d FROM events)
SELECT event_id, printf('%.2f', a)::DOUBLE AS a2, printf('%.3f', a)::DOUBLE AS a3, printf('%.2f', b)::DOUBLE AS b2, printf('%.3f', c)::DOUBLE AS c3, printf('%.2f', d)::DOUBLE AS d2 FROM v""")
def exact_rounding(spark, sf_dir):
    """Ordinary values, decimals that end in a five, and sixteenths, which are ties in binary."""
    two, three, i, x = scalar.exact_round(2), scalar.exact_round(3), F.col("event_id"), F.col("value")
    a, b, c, d = x * 1.37, (i * 10 + 5) / F.lit(1000.0), i / F.lit(16.0), -x / 7
    return table(spark, sf_dir, "events").select("event_id", two(a).alias("a2"), three(a).alias("a3"), two(b).alias("b2"), three(c).alias("c3"), two(d).alias("d2"))


#: Captions with what real files have: a byte order mark, notes, cues without hours, odd tags, settings, blank and white lines, commas, head lines within a cue.
_ODD = r"""o AS (SELECT video_id, seq, s, e, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM sp),
b AS (SELECT video_id, seq, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS k, s, e, CASE seq % 5 WHEN 0 THEN text || ' 00:00:09.000 --> 00:00:10.000' WHEN 1 THEN text || ' (more)' WHEN 3 THEN NULL ELSE text END AS text FROM o WHERE seq % 5 <> 4)"""


@query("vtt_odd", rf"""WITH {_SPOKEN}, {_ODD}, q AS (SELECT video_id, seq, s, e, trim(text) AS text FROM b WHERE trim(text) <> '')
SELECT video_id, seq, printf('%.3f', s)::DOUBLE AS "start", printf('%.3f', e)::DOUBLE AS "end", text FROM q""")
def vtt_odd(spark, sf_dir):
    """Cues without a collapse; seq is the turn, which the cue's end carries in its milliseconds' place as a setting."""
    c = spoken(spark, sf_dir).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    stamp = lambda x, sep: F.format_string(f"%02d:%02d:%02d{sep}%03d", F.floor(x / 3600000), F.floor(x / 60000) % 60, F.floor(x / 1000) % 60, x % 1000)
    ms, me, turn = F.rint(F.col("start") * 1000).cast("long"), F.rint(F.col("end") * 1000).cast("long"), F.col("seq")
    hourless = F.format_string("%02d:%02d.%03d --> 59:59.000", F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)
    head = F.when(turn % 5 == 4, hourless).otherwise(F.concat(stamp(ms, "."), F.lit(" -->\t"), stamp(me, ","), F.lit(" align:start position:0%")))
    body = (
        F.when(turn % 5 == 0, F.concat(F.lit("<v Speaker>"), F.col("text"), F.lit("</v>\r\n00:00:09.000 --> 00:00:10.000")))
        .when(turn % 5 == 1, F.concat(F.lit(" <i.x>"), F.col("text"), F.lit("</i> \n<b></b>\n(more) ")))
        .when(turn % 5 == 3, F.lit("<c></c>"))
        .otherwise(F.concat(F.lit("<00:00:01.000>"), F.col("text")))
    )
    cue = F.concat(F.lit("NOTE "), turn.cast("string"), F.lit("\n"), head, F.lit("\n"), body, F.when(turn % 2 == 0, F.lit("\n  \t\n")).otherwise(F.lit("\n\n")))
    files = c.select(F.concat_ws("/", "video_id", "seq").alias("video_id"), F.concat(F.lit("﻿WEBVTT\n\n"), cue).alias("value"))
    d = captions.parse_cues(files)
    part = lambda n: F.split_part("video_id", F.lit("/"), F.lit(n)).cast("long")
    return d.select(part(1).alias("video_id"), part(2).alias("seq"), (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
