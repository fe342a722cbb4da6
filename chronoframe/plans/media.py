"""Queries over frame tables, scopes, labels and report heads; the tables stand for recordings as in the timeline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoframe.functions import scalar
from chronoframe.operators import budget, frames, intervals, report, sampling, selection
from chronoframe.plans.registry import query
from chronoframe.plans.timeline import _ISL, _SCENES, by_recording, ranged, ranged_scenes, scenes, segments, table, windows

_REL = "w AS (SELECT win.video_id, win, n, (s - lo) / 1e6 AS a, (e - lo) / 1e6 AS z, (hi - lo) / 1e6 AS d FROM win JOIN rng USING (video_id))"


def _relative(s):
    """Windows in seconds since their recording's begin, and its duration."""
    at = lambda x: ((F.col(x) - F.col("lo")) / 1e6).alias({"start": "a", "end": "z", "hi": "d"}[x])
    return ranged(windows(s)).select("video_id", "win", "n", at("start"), at("end"), at("hi"))


def _time(x: str) -> str:
    t = f"round_even({x}, 0)::BIGINT"
    return f"CASE WHEN {t} >= 3600 THEN printf('%d:%02d:%02d', {t} // 3600, {t} % 3600 // 60, {t} % 60) ELSE printf('%02d:%02d', {t} // 60, {t} % 60) END"


@query("fixed_rate_budget", f"WITH {_ISL}, {_REL} SELECT video_id, win, 0.01::DOUBLE AS fps, greatest(1, round_even(0.01::DOUBLE * (z - a), 0)::BIGINT) AS requested, least(100, greatest(1, round_even(0.01::DOUBLE * (z - a), 0)::BIGINT)) AS extracted FROM w")
def fixed_rate_budget(spark, sf_dir):
    fps, n = budget.fixed_rate_budget(F.col("z") - F.col("a"), F.lit(0.01))
    return _relative(segments(spark, sf_dir)).select("video_id", "win", fps.alias("fps"), n.alias("requested"), F.least(n, F.lit(budget.MAX_FRAMES)).alias("extracted"))


@query("frame_times", f"""WITH {_ISL}, {_REL}, k AS (SELECT video_id, win, a, unnest(range(least(100, greatest(1, round_even(0.01::DOUBLE * (z - a), 0)::BIGINT)))) AS i FROM w)
SELECT video_id, win, i::INT AS idx, round_even((a + i / 0.01::DOUBLE) * 100, 0) / 100 AS timestamp_seconds, printf('frame_%04d.jpg', i + 1) AS path FROM k""")
def frame_times(spark, sf_dir):
    w, (fps, n) = _relative(segments(spark, sf_dir)), budget.fixed_rate_budget(F.col("z") - F.col("a"), F.lit(0.01))
    return frames.at_fixed_rate(w.select("video_id", "win", F.col("a").alias("start"), fps.alias("fps"), n.alias("frames")), ["video_id", "win"])


@query("frames_at_moments", f"""WITH {_ISL}, {_SCENES}, m AS (SELECT sc.video_id, sc.mid, (mid - lo) / 1e6 AS t, row_number() OVER (PARTITION BY sc.video_id ORDER BY (mid - lo) / 1e6) - 1 AS i FROM sc JOIN rng USING (video_id))
SELECT video_id, i::INT AS idx, round_even(t * 100, 0) / 100 AS timestamp_seconds, printf('frame_%04d.jpg', i + 1) AS path FROM m
WHERE EXISTS (SELECT 1 FROM win WHERE n > 1 AND win.video_id = m.video_id AND m.mid BETWEEN win.s AND win.e)""")
def frames_at_moments(spark, sf_dir):
    s = segments(spark, sf_dir)
    tagged = intervals.tagged(intervals.with_midpoints(ranged_scenes(s)), windows(s).where("n > 1"), "midpoint").select("video_id", "tag", ((F.col("midpoint") - F.col("lo")) / 1e6).alias("at"))
    return frames.at_moments(tagged, tagged.where("tag = '[speech]'"))


@query("scene_cuts", """WITH f AS (SELECT user_id AS video_id, epoch_us(ts) AS t, event_id, value FROM events), o AS (SELECT video_id, t, max(value) AS score FROM f GROUP BY ALL),
b AS (SELECT video_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t) AS n, max(t) OVER (PARTITION BY video_id) AS last, score FROM o),
c AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t) - 1 AS scene_no, t AS s, coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY t), last) AS e, count(*) OVER (PARTITION BY video_id) AS k FROM b WHERE n = 1 OR score >= 27)
SELECT video_id, scene_no::INT AS scene_no, s AS "start", e AS "end" FROM c WHERE k > 1""")
def scene_cuts(spark, sf_dir):
    e = segments(spark, sf_dir).select("video_id", "seq", F.col("start").alias("at"))
    scores = e.join(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    return frames.scenes_of(scores.groupBy("video_id", "at").agg(F.max("value").alias("score")))


@query("model_chain", """WITH a AS (SELECT conv_id, role, CASE WHEN bool_or(text IS NOT NULL) THEN sum(length(text))::BIGINT END AS n FROM conversations GROUP BY ALL),
r AS (SELECT *, CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 END AS k FROM a WHERE n IS NOT NULL AND role IN ('assistant', 'user'))
SELECT conv_id AS video_id, arg_min(role, k) AS model, arg_min(n, k) AS total FROM r GROUP BY 1""")
def model_chain(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id"), F.col("role").alias("model")).agg(F.sum(F.length("text")).alias("n"))
    attempts = c.select("video_id", "model", F.when(F.col("n").isNotNull(), F.array(F.col("n").cast("long"))).alias("segments"))
    return frames.by_chain(attempts, ["assistant", "assistant", "user"]).select("video_id", "model", F.get("segments", 0).alias("total"))


@query("backend_labels", """SELECT doc_id, 'whisper (' || CASE WHEN lang = 'en' THEN 'local, ' || coalesce(source, 'unknown') WHEN n_chars > 1000 THEN 'assemblyai, diarized' ELSE 'assemblyai' END || CASE WHEN n_chars > 5000 THEN ', --audio' ELSE '' END || ')' AS label
FROM documents""")
def backend_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    backend = F.when(F.col("lang") == "en", F.lit("local")).otherwise(F.lit("assemblyai"))
    return d.select("doc_id", frames.backend_label(backend, F.coalesce("source", F.lit("unknown")), F.col("n_chars") > 1000, F.col("n_chars") > 5000).alias("label"))


@query("scope_faults", f"""WITH {_ISL}, {_REL} SELECT video_id, win, CASE WHEN a - 3600 < 0 THEN 'start is negative' WHEN z - 7200 <= a - 3600 THEN 'end is not after start' WHEN d > 0 AND a - 3600 >= d THEN 'start is past the end' END AS fault FROM w""")
def scope_faults(spark, sf_dir):
    return _relative(segments(spark, sf_dir)).select("video_id", "win", selection.scope_fault(F.col("d"), F.col("a") - 3600, F.col("z") - 7200).alias("fault"))


@query("effective_scope", f"""WITH {_ISL}, {_REL}, q AS (SELECT *, CASE WHEN n > 1 THEN a END AS x, CASE WHEN n > 2 THEN z END AS y FROM w)
SELECT video_id, win, coalesce(x, 0.0::DOUBLE) AS "start", coalesce(y, d) AS "end", greatest(0.0::DOUBLE, coalesce(y, d) - coalesce(x, 0.0::DOUBLE)) AS duration, x IS NOT NULL OR y IS NOT NULL AS focused,
CASE WHEN NOT (x IS NOT NULL OR y IS NOT NULL) AND d > 600 THEN '> **Warning:** This is a ' || floor(d / 60)::BIGINT::VARCHAR || '-minute video. Frame coverage is sparse at this length — accuracy degrades noticeably on anything over 10 minutes. For better results, re-run with `--start HH:MM:SS --end HH:MM:SS` to zoom into a specific section.' END AS warning FROM q""")
def effective_scope(spark, sf_dir):
    s, e, length, focused = selection.scope(F.col("d"), F.when(F.col("n") > 1, F.col("a")), F.when(F.col("n") > 2, F.col("z")))
    return _relative(segments(spark, sf_dir)).select("video_id", "win", s.alias("start"), e.alias("end"), length.alias("duration"), focused.alias("focused"), report.long_warning(F.col("d"), focused).alias("warning"))


@query("points_away", f"""WITH {_ISL}, {_REL}, {_SCENES}, m AS (SELECT sc.video_id, (mid - lo) / 1e6 AS mid FROM sc JOIN rng USING (video_id)), p AS (SELECT video_id, win, a + (z - a) / 11 * unnest(range(1, 11)) AS t, greatest(0.5, (z - a) * 0.05) AS tol FROM w WHERE z > a)
SELECT video_id, win, t FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = p.video_id AND abs(p.t - m.mid) <= tol)""")
def points_away(spark, sf_dir):
    s, a, z = by_recording(segments(spark, sf_dir)), F.col("a"), F.col("z")
    mids = intervals.with_midpoints(ranged_scenes(s)).select("video_id", ((F.col("midpoint") - F.col("lo")) / 1e6).alias("mid"))
    points = _relative(s).select("video_id", "win", F.greatest(F.lit(0.5), (z - a) * 0.05).alias("tolerance"), F.explode(sampling.evenly_spaced(a, z, F.lit(10))).alias("t"))
    return intervals.points_away(points, mids, "t", "mid", "tolerance").select("video_id", "win", "t")


@query("thinning_collisions", f"WITH {_ISL}, {_SCENES}, c AS (SELECT video_id, count(*)::INT AS n FROM sc GROUP BY 1) SELECT video_id, n, least(n, 7)::INT AS picked FROM c")
def thinning_collisions(spark, sf_dir):
    """How many positions are picked: as many as asked for, since those of fewer than n never round to the same."""
    n = scenes(segments(spark, sf_dir)).groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    return n.select("video_id", "n", F.size(sampling.thin_indices(F.col("n"), F.lit(7))).alias("picked"))


@query("text_labels", """SELECT doc_id, CASE WHEN n_chars * 100 < 1048576 THEN printf('%d KB', round_even(n_chars * 100 / 1024, 0)::BIGINT) ELSE printf('%.1f MB', n_chars * 100 / 1048576) END AS size, substr(text, 1, 400) AS shortened, lang AS state
FROM documents""")
def text_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    state = scalar.state_name(F.concat(F.lit("State."), F.col("lang")))
    return d.select("doc_id", scalar.size_label(F.col("n_chars") * 100).alias("size"), scalar.shortened(F.col("text")).alias("shortened"), state.alias("state"))


