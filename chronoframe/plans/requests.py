"""Queries over requests and over ways of sampling that fall through."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.operators import frames, intervals, routing, stages
from chronoframe.plans.registry import query
from chronoframe.plans.timeline import _ISL, _SCENES, ranges, scenes, segments, table, windows

#: What the stand-in for an extractor cannot do: all moments of some recordings, by way; other moments at random.
_FAILS = {"two-pass": 4, "scenes": 8, "fps": 16}


@query("sampling_fallback", f"""WITH {_ISL}, {_SCENES}, a AS (SELECT win.video_id, 'two-pass' AS mode, row_number() OVER (PARTITION BY win.video_id ORDER BY win) - 1 AS i, (s - lo) / 1e6 AS t FROM win JOIN rng USING (video_id) WHERE n > 1 AND win.video_id % 2 = 0 AND win.video_id % 5 <> 0),
s0 AS (SELECT sc.video_id, (mid - lo) / 1e6 AS t, row_number() OVER (PARTITION BY sc.video_id ORDER BY s, scene_no) - 1 AS k, count(*) OVER (PARTITION BY sc.video_id) AS n FROM sc JOIN rng USING (video_id) WHERE sc.video_id % 5 <> 0),
b AS (SELECT video_id, 'scenes' AS mode, row_number() OVER (PARTITION BY video_id ORDER BY k) - 1 AS i, t FROM s0 WHERE n <= 6 OR list_contains(list_transform(range(6), lambda j: round_even(j * ((n - 1) / 5), 0)::BIGINT), k)),
c AS (SELECT video_id, 'fps' AS mode, i, i / 0.5::DOUBLE AS t FROM rng, (SELECT unnest(range(5)) AS i)),
e AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) WHERE video_id % CASE mode WHEN 'two-pass' THEN 4 WHEN 'scenes' THEN 8 ELSE 16 END <> 0 AND floor(t)::BIGINT % 3 <> 1),
f AS (SELECT video_id, min(CASE mode WHEN 'two-pass' THEN 1 WHEN 'scenes' THEN 2 ELSE 3 END) AS best FROM e GROUP BY 1)
SELECT video_id, mode, i::INT AS idx, printf('%.2f', t)::DOUBLE AS timestamp_seconds, printf('frame_%04d.jpg', i + 1) AS path FROM e JOIN f USING (video_id) WHERE best = CASE mode WHEN 'two-pass' THEN 1 WHEN 'scenes' THEN 2 ELSE 3 END""")
def sampling_fallback(spark, sf_dir):
    """Frames of the first way that yields any: begins of windows, else midpoints of scenes, else a fixed rate."""
    s, v = segments(spark, sf_dir), F.col("video_id")
    r = ranges(s)
    at = lambda c: ((F.col(c) - F.col("lo")) / 1e6).alias(c)
    begins = windows(s).where("n > 1").join(r, "video_id").groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("win", at("start")))).alias("w")).select("video_id", F.col("w.start").alias("begins"))
    mids = stages.scene_moments(scenes(s).join(r, "video_id").select("video_id", "scene_no", at("start"), at("end")), 6)
    d = r.select("video_id").join(begins, "video_id", "left").join(mids, "video_id", "left")
    ways = [
        stages.Stage("two-pass", (v % 2 == 0) & (v % 5 != 0) & (F.size("begins") > 0), lambda x: stages.listed(x, F.col("begins"))),
        stages.Stage("scenes", (v % 5 != 0) & (F.size("moments") > 0), lambda x: stages.listed(x, F.col("moments"))),
        stages.Stage("fps", F.lit(True), lambda x: stages.listed(x, frames.frame_times(F.lit(0.0), F.lit(0.5), F.lit(5)))),
    ]
    fails = F.when(F.col("mode") == "two-pass", v % _FAILS["two-pass"]).when(F.col("mode") == "scenes", v % _FAILS["scenes"]).otherwise(v % _FAILS["fps"]) == 0
    made, _ = stages.fall_through(d, ways, lambda m: m.where(~fails & (F.floor("at") % 3 != 1)))
    return made


_REQUESTS = r"""q AS (SELECT page_id AS v, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/videos/' || page_id || '.mp4' WHEN 2 THEN '/videos/' || page_id || '.TXT' ELSE '/videos/' || page_id || '.mkv' END AS source, CASE page_id % 6 WHEN 1 THEN '/sound/' || page_id || '.mp3' WHEN 2 THEN '/videos/1.mp4' END AS audio,
page_id % 3 = 1 AS mute, CASE page_id % 5 WHEN 1 THEN 'gemini' WHEN 2 THEN 'openrouter' ELSE 'claude' END AS backend, CASE WHEN page_id % 10 < 5 THEN ' why? ' ELSE '  ' END AS question, CASE page_id % 7 WHEN 1 THEN -1.5 WHEN 2 THEN 30 WHEN 3 THEN 700 END::DOUBLE AS st, page_id % 7 = 4 AS bad, CASE page_id % 9 WHEN 1 THEN 20 WHEN 2 THEN 60 END::DOUBLE AS en, CASE WHEN page_id % 8 = 0 THEN 0 ELSE 600 END::DOUBLE AS d FROM pages),
k AS (SELECT *, coalesce(regexp_matches(source, '(?i)^https?://[^/?#]+'), false) AS url, v % 4 IN (1, 2) AS there FROM q),
r AS (SELECT *, list_filter([CASE WHEN audio IS NOT NULL AND mute THEN '--audio implies Whisper transcription of that file; cannot combine with --no-whisper' END, CASE WHEN v % 6 = 1 THEN '--audio file not found: ' || audio END, CASE WHEN backend <> 'claude' AND trim(question) = '' THEN '--backend ' || backend || ' requires a question' END,
CASE WHEN NOT url AND NOT there THEN 'File not found: ' || coalesce(source, '') END, CASE WHEN bad THEN 'not a time: 1:x' END, CASE WHEN backend = 'claude' AND st < 0 THEN '--start must be non-negative' END, CASE WHEN backend = 'claude' AND en <= st THEN '--end must be greater than --start' END,
CASE WHEN backend = 'claude' AND d > 0 AND st >= d THEN '--start ' || printf('%.1f', st) || 's is past end of video (' || printf('%.1f', d) || 's)' END], lambda x: x IS NOT NULL) AS reasons FROM k)"""


def _requests(spark, sf_dir):
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    n = i.cast("string")
    named = lambda folder, suffix: F.concat(F.lit(folder), n, F.lit(suffix))
    requests = p.select(
        i.alias("video_id"), F.when(i % 4 == 0, F.col("url")).when(i % 4 == 1, named("/videos/", ".mp4")).when(i % 4 == 2, named("/videos/", ".TXT")).otherwise(named("/videos/", ".mkv")).alias("source"), F.when(i % 6 == 1, named("/sound/", ".mp3")).when(i % 6 == 2, "/videos/1.mp4").alias("audio"), (i % 3 == 1).alias("no_whisper"),
        F.when(i % 5 == 1, "gemini").when(i % 5 == 2, "openrouter").otherwise("claude").alias("backend"), F.when(i % 10 < 5, " why? ").otherwise("  ").alias("question"), F.when(i % 7 == 1, "-1.5").when(i % 7 == 2, "0:30").when(i % 7 == 3, "11:40").when(i % 7 == 4, "1:x").alias("start"), F.when(i % 9 == 1, "20").when(i % 9 == 2, "1:00").otherwise(" ").alias("end"), F.when(i % 8 == 0, 0.0).otherwise(600.0).alias("duration"),
    )
    files = p.where(i % 4 == 1).select(named("/videos/", ".mp4").alias("path")).union(p.where(i % 4 == 2).select(named("/videos/", ".TXT")))
    return requests, files.union(spark.range(1).select(F.lit("/videos/1.mp4")))


@query("requests_accepted", f"WITH {_REQUESTS} SELECT v AS video_id, source, CASE WHEN url THEN 'download' ELSE 'local' END AS route, CASE WHEN NOT url THEN regexp_extract(source, '([^/]*)$', 1) END AS title, st AS start_seconds, en AS end_seconds, CASE WHEN NOT url AND v % 4 = 2 THEN '.txt is not a known video extension, proceeding anyway' END AS warning FROM r WHERE len(reasons) = 0")
def requests_accepted(spark, sf_dir):
    accepted, _, _ = routing.routed(*_requests(spark, sf_dir))
    return accepted.select("video_id", "source", "route", "title", "start_seconds", "end_seconds", "warning")


@query("requests_rejected", f"WITH {_REQUESTS} SELECT v AS video_id, (unnest(range(len(reasons))))::INT AS at, unnest(reasons) AS reason FROM r")
def requests_rejected(spark, sf_dir):
    _, rejected, _ = routing.routed(*_requests(spark, sf_dir))
    return rejected


#: All events as one recording, each a 400th as long, which is dealt out over many tasks.
_ONE = """e1 AS (SELECT event_id AS seq, epoch_us(ts) AS s, epoch_us(ts) + floor(value * 60e6)::BIGINT // 400 AS e, event_type FROM events), m1 AS (SELECT *, CASE WHEN s - max(e) OVER (ORDER BY s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1000000 THEN 0 ELSE 1 END AS new FROM e1),
n1 AS (SELECT *, sum(new) OVER (ORDER BY s, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS win FROM m1), w1 AS (SELECT win, min(s) AS s, max(e) AS e, count(*) AS n FROM n1 GROUP BY 1)"""


def _one(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.withColumns({"video_id": F.lit(0).cast("long"), "end": F.col("start") + F.floor((F.col("end") - F.col("start")) / 400)})


def _parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("large_recording_windows", f'WITH {_ONE} SELECT 0::BIGINT AS video_id, win, s AS "start", e AS "end", n FROM w1')
def large_recording_windows(spark, sf_dir):
    return intervals.islands(_one(spark, sf_dir), F.lit(1_000_000), parts=_parts(spark))


@query("large_recording_gaps", f'WITH {_ONE}, b AS (SELECT e AS s, lead(s) OVER (ORDER BY s) AS e FROM w1) SELECT 0::BIGINT AS video_id, s AS "start", e AS "end" FROM b WHERE e > s')
def large_recording_gaps(spark, sf_dir):
    s = _one(spark, sf_dir)
    return intervals.gaps(intervals.islands(s, F.lit(1_000_000), parts=_parts(spark)), ranges(s), parts=_parts(spark))


@query("large_recording_tags", f"WITH {_ONE} SELECT 0::BIGINT AS video_id, seq AS scene_no, CASE WHEN EXISTS (SELECT 1 FROM w1 WHERE n > 2 AND (e1.s + e1.e) / 2 BETWEEN w1.s AND w1.e) THEN '[speech]' ELSE '[silent]' END AS tag FROM e1 WHERE event_type = 'purchase'")
def large_recording_tags(spark, sf_dir):
    s = _one(spark, sf_dir)
    w = intervals.islands(s, F.lit(1_000_000), parts=_parts(spark)).where("n > 2")
    return intervals.tagged(intervals.with_midpoints(scenes(s)), w, "midpoint", parts=_parts(spark)).select("video_id", "scene_no", "tag")


@query("points_in_any_window", f"WITH {_ISL}, {_SCENES} SELECT video_id, scene_no FROM sc WHERE EXISTS (SELECT 1 FROM win WHERE n > 2 AND win.video_id = sc.video_id AND sc.mid BETWEEN win.s AND win.e)")
def points_in_any_window(spark, sf_dir):
    s = segments(spark, sf_dir)
    return intervals.points_in_windows(intervals.with_midpoints(scenes(s)), windows(s).where("n > 2"), "midpoint", how="left_semi").select("video_id", "scene_no")


@query("points_with_windows", f"WITH {_ISL}, {_SCENES} SELECT sc.video_id, scene_no, x.win FROM sc LEFT JOIN (SELECT * FROM win WHERE n > 2) x ON x.video_id = sc.video_id AND sc.mid BETWEEN x.s AND x.e")
def points_with_windows(spark, sf_dir):
    s = segments(spark, sf_dir)
    return intervals.points_in_windows(intervals.with_midpoints(scenes(s)), windows(s).where("n > 2"), "midpoint", how="left").select("video_id", "scene_no", "win")
