"""Rounding, range joins, large recordings, plans, reports, files, fallback, routing, SQL functions and streams, against plain folds."""

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.functions import scalar, sql
from chronoframe.operators import budget, captions, intervals, report, routing, sampling, stages
from chronoframe.plans import registry, timeline
from chronoframe.sources import files, media


def test_rounding_is_that_of_binary_values(spark):
    r = np.random.default_rng(1)
    n = 60_000
    x = np.concatenate([r.normal(size=n) * 10.0 ** r.integers(-5, 16, n), (r.integers(0, 10**7, n) * 10 + 5) / 1000, (r.integers(0, 10**7, n) * 10 + 5) / 10000, r.integers(-(10**6), 10**6, n) / 64, np.ldexp(1 + r.integers(0, 1 << 52, n) / (1 << 52), r.integers(40, 48, n))])
    x = np.concatenate([x, np.nextafter(x, np.inf)[: n * 3], [0.0, -0.0, -0.001, math.inf, -math.inf, 1e308, 5e-324, 2.675, 1.005, 0.125]])
    d = spark.createDataFrame(pd.DataFrame({"x": x}))
    for digits in (2, 3):
        got = d.select("x", scalar.exact_round(digits)(F.col("x")).alias("y")).toPandas()
        expected = np.array([round(v, digits) for v in got["x"].tolist()])
        assert (got["y"].to_numpy() == expected).all() and (np.signbit(got["y"]) == np.signbit(expected)).all()
    odd = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(scalar.exact_round(2)(F.col("x"))).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0])


@pytest.mark.parametrize("name", ["frame_times", "vtt_parse", "response_normalise", "two_pass_plan", "frames_at_moments", "exact_rounding", "report_text"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_two_pass_plan_shuffles_little(spark):
    plan = registry.queries()["two_pass_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("Exchange hashpartitioning") <= 6


def test_points_away_holds_little_in_a_task(spark, monkeypatch):
    """One pass for each side, without joins, over as many tasks as the rows ask for."""
    monkeypatch.setattr(timeline, "TASK_ROWS", 100)
    d = registry.queries()["points_away"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and 0 < plan.count("Exchange hashpartitioning") <= 2
    assert d.rdd.getNumPartitions() == 10


def test_report_parts_share_their_heads(spark, monkeypatch):
    """A report's parts read heads that are made once, in one pass, and tasks grow in number with the rows."""
    monkeypatch.setattr(timeline, "TASK_ROWS", 100)
    d = registry.queries()["report_text"](spark, "/root/testdata/sf0.001")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Window ") <= 8
    assert "hashpartitioning(video_id" in plan and ", 10)" in plan


def test_windows_with_further_aggregates(spark):
    segs, rows = segments_of(spark, 6, 500, [1, 2])
    odd = F.count_if(F.col("seq") % 2 == 1).alias("odd")
    for parts in (None, 5):
        w = intervals.islands(segs, F.lit(2), parts=parts, more=[odd]).collect()
        assert sorted(tuple(x)[:5] for x in w) == sorted(map(tuple, intervals.islands(segs, F.lit(2)).collect()))
        for x in w:
            assert x.odd == sum(k == x.video_id and i % 2 == 1 and x.start <= s <= x.end for k, i, s, _ in rows)


def test_points_away_of_large_recordings(spark):
    r = random.Random(8)
    points = [(r.choice(["a", "a", "b", "d", None]), i, r.choice([r.randint(0, 900), None]) if i % 9 == 0 else r.randint(0, 900), r.choice([0, 1, 4, 90, None])) for i in range(400)]
    others = [(r.choice(["a", "b", "c", None]), r.choice([r.randint(0, 900), None])) for _ in range(90)]
    p, o = spark.createDataFrame(points, "video_id string, i long, t long, tolerance long"), spark.createDataFrame(others, "video_id string, o long")
    far = sorted(i for k, i, t, by in points if k is None or t is None or by is None or all(x != k or s is None or abs(t - s) > by for x, s in others))
    for parts in (None, 5):
        assert sorted(x.i for x in intervals.points_away(p, o, "t", "o", "tolerance", parts=parts).collect()) == far


def segments_of(spark, seed, n, keys):
    r = random.Random(seed)
    rows = [(r.choice(keys), i, (s := r.randint(0, 4 * n)), s + r.choice([0, 1, 2, 3, 40])) for i in range(n)]
    return spark.createDataFrame(rows, "video_id long, seq long, start long, end long"), rows


@pytest.mark.parametrize("keys", [[1], [1, 1, 1, 1, 2, 3, None]])
def test_large_recordings_are_dealt_out(spark, keys):
    segs, _ = segments_of(spark, 5, 2000, keys)
    plain, dealt = intervals.islands(segs, F.lit(2)), intervals.islands(segs, F.lit(2), parts=7)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    ranges = plain.groupBy("video_id").agg((F.min("start") - 5).alias("lo"), (F.max("end") + 5).alias("hi"))
    assert sorted(map(tuple, intervals.gaps(plain, ranges, parts=7).collect())) == sorted(map(tuple, intervals.gaps(plain, ranges).collect()))
    from chronoframe.operators.prefix import PART, dealt as deal

    sizes = [r["count"] for r in deal(segs, "video_id", ["start", "seq"], 7).groupBy(PART).count().collect()]
    assert len(sizes) >= 5 and max(sizes) < 2000 / 3


def test_range_joins_against_all_pairs(spark):
    r = random.Random(2)
    windows = [(r.choice("ab"), i, (s := r.randint(0, 300)), s + r.choice([0, 1, 5, 200, -3])) for i in range(120)] + [("c", 0, 5, 5), ("a", 900, None, 5), (None, 901, 0, 99)]
    points = [(r.choice("abd"), i, float(r.randint(0, 330)) + r.choice([0, 0.5])) for i in range(150)] + [("c", 200, 5.0), ("c", 201, None), (None, 202, 1.0)]
    w = spark.createDataFrame(windows, "video_id string, win long, start long, end long")
    p = spark.createDataFrame(points, "video_id string, i long, t double")
    hits = lambda k, t: [v[1] for v in windows if k is not None and t is not None and v[0] == k and v[2] is not None and v[2] <= t <= v[3]]
    pairs = sorted((i, x) for k, i, t in points for x in hits(k, t))
    assert sorted((x.i, x.win) for x in intervals.points_in_windows(p, w, "t").collect()) == pairs
    left = intervals.points_in_windows(p, w, "t", how="left").collect()
    assert sorted((x.i, x.win) for x in left if x.win is not None) == pairs and sorted(x.i for x in left if x.win is None) == sorted(i for k, i, t in points if not hits(k, t))
    assert sorted(x.i for x in intervals.points_in_windows(p, w, "t", how="left_semi").collect()) == sorted(i for k, i, t in points if hits(k, t))
    for parts in (None, 5):
        tags = {x.i: x.tag for x in intervals.tagged(p, w, "t", parts=parts).collect()}
        assert tags == {i: "[speech]" if hits(k, t) else "[silent]" for k, i, t in points}
    near = spark.createDataFrame([(k, i, t, 0.5 + i % 4) for k, i, t in points if k and t is not None], "video_id string, i long, t double, tolerance double")
    others = spark.createDataFrame([(k, i, float(s)) for k, i, s, _ in windows[:40]], "video_id string, j long, o double")
    far = sorted(i for k, i, t in points if k and t is not None and all(abs(t - s) > 0.5 + i % 4 for x, _, s, _ in windows[:40] if x == k))
    assert sorted(x.i for x in intervals.points_away(near, others, "t", "o", "tolerance").collect()) == far


def test_a_million_windows_of_one_recording(spark):
    w = spark.range(1_000_000).select(F.lit("v").alias("video_id"), F.col("id").alias("win"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    p = spark.range(0, 10_000_000, 97).select(F.lit("v").alias("video_id"), F.col("id").alias("t"))
    expected = sum(t % 10 <= 4 for t in range(0, 10_000_000, 97))
    assert intervals.points_in_windows(p, w, "t").count() == expected
    assert intervals.tagged(p, w, "t", parts=8).where("tag = '[speech]'").count() == expected


def trimmed(lengths, total, n):
    parts = [max(1, round(n * (x / total))) for x in lengths]
    over = sum(parts) - n
    for _ in range(max(0, over)):
        top = max(parts)
        if top == 1:
            break
        parts[parts.index(top)] -= 1
    if over < 0:
        parts[lengths.index(max(lengths))] -= over
    return parts


def test_shares_against_a_loop(spark):
    r = random.Random(8)
    rows = [([float(r.choice([0, 1, 1, 2, 5, 30, 31])) for _ in range(r.randint(1, 14))] + [1.0], r.randint(1, 90)) for _ in range(1500)] + [([], 5), ([1.0], 0)]
    d = spark.createDataFrame(rows, "lengths array<double>, n long")
    got = d.select("lengths", "n", budget.shares(F.col("lengths"), F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x), F.col("n")).alias("k")).collect()
    assert len(got) == len(rows) and all(x.k == (trimmed(x.lengths, sum(x.lengths), x.n) if x.lengths else []) for x in got)


def pick(s, e, mids, n):
    """Moments of one piece, as sampling.picked describes them."""
    if n <= 0 or e <= s:
        return []
    even = lambda k: [(s + e) / 2] if k == 1 else [s + (e - s) / (k + 1) * (i + 1) for i in range(k)]
    own = sorted(m for m in mids if s <= m <= e)
    if len(own) >= n:
        return [own[len(own) // 2]] if n == 1 else [own[i] for i in sorted({round(k * ((len(own) - 1) / (n - 1))) for k in range(n)})]
    far = [c for c in even(n + 1) if all(abs(c - m) > max(0.5, (e - s) * 0.05) for m in own)]
    need = n - len(own)
    return sorted(own + (far[:need] if len(far) >= need else even(need)))


def planned(lo, hi, most, windows, mids):
    if most <= 0 or hi <= lo:
        return [], 0, 0.0, 0.0
    edges, at = [], lo
    for s, e in [*windows, (hi, hi)]:
        if s > at:
            edges.append((at, s))
        at = max(at, e)
    speech, silent = min(sum(e - s for s, e in windows), hi - lo), sum(e - s for s, e in edges)
    if speech <= 0:
        return pick(lo, hi, [], 0) or ([(lo + hi) / 2] if most == 1 else [lo + (hi - lo) / (most + 1) * (i + 1) for i in range(most)]), 0, 0.0, silent
    a = most if silent <= 0 else max(1, round(most * 0.7))
    b = most - a
    if silent > 0 and b < 1 and most > 1:
        a, b = most - 1, 1
    chosen = []
    for pieces, total, n in ((windows, speech, a), (edges, silent, b)):
        if n > 0 and pieces:
            for (s, e), k in zip(pieces, trimmed([e - s for s, e in pieces], total, n), strict=True):
                chosen += pick(s, e, mids, k)
    every = sorted({round(t, 3) for t in chosen})
    if len(every) > most:
        every = [every[i] for i in sorted({round(k * ((len(every) - 1) / (most - 1) if most > 1 else 0)) for k in range(most)})]
    return every, sum(any(s <= t <= e for s, e in windows) for t in every), speech, silent


def test_plan_against_loops(spark):
    r = random.Random(4)
    cases = {}
    for v in range(150):
        cuts = sorted(r.sample(range(0, 400), 2 * r.randint(0, 9)))
        windows = [(a / 2, b / 2) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        mids = [r.randint(0, 400) / 2 for _ in range(r.choice([0, 3, 40]))] + [x for w in windows[:2] for x in w]
        cases[v] = (0.0, r.choice([200.0, 200.0, 0.0]), r.choice([0, 1, 2, 3, 10, 80]), windows, mids)
    cases[900] = (0.0, 10.0, 10, [(0.0, 10.0)], [])
    ranges = spark.createDataFrame([(v, lo, hi, n) for v, (lo, hi, n, *_) in cases.items()], "video_id long, lo double, hi double, max_frames long")
    w = spark.createDataFrame([(v, s, e) for v, c in cases.items() for s, e in c[3]], "video_id long, start double, end double")
    m = spark.createDataFrame([(v, x) for v, c in cases.items() for x in c[4]] + [(3, None), (None, 1.0)], "video_id long, midpoint double")
    got = sampling.two_pass_plan(ranges, w, m).collect()
    assert len(got) == len(cases)
    for x in got:
        moments, speech, a, b = planned(*cases[x.video_id])
        assert x.timestamps == moments, (x.video_id, cases[x.video_id])
        assert (x.speech_count, x.non_speech_count) == (speech, len(moments) - speech)
        if cases[x.video_id][2] > 0 and cases[x.video_id][1] > 0:
            assert (x.speech_total_seconds, x.non_speech_total_seconds) == (a, b)


def test_bytes_that_are_not_text(spark, tmp_path):
    r = random.Random(6)
    alphabet = [b"a", b"\n", "é".encode(), "漢".encode(), "😀".encode(), b"\xff", b"\xe2\x82", b"\xc0\x80", b"\xed\xa0\x80", b"\xf0\x9f", b"\xf5", b"\x80", b"\xe0\x80\x80", b"\xf4\x90\x80\x80", b"\x00"]
    contents = [b"".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(400)] + [bytes(r.randrange(256) for _ in range(200)) for _ in range(100)] + [b"\xe2\x82" * 200_000]
    got = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "i long, c binary").select("i", scalar.lenient_text(F.col("c")).alias("t")).collect()
    assert all(x.t == contents[x.i].decode("utf-8", errors="ignore") for x in got)
    for i, c in enumerate(contents[:40]):
        (tmp_path / f"v{i}").mkdir()
        (tmp_path / f"v{i}" / "video.en.vtt").write_bytes(c)
    (tmp_path / "v0" / "other.txt").write_text("x")
    expected = sorted((f"v{i}", "video.en.vtt", c.decode("utf-8", errors="ignore")) for i, c in enumerate(contents[:40]))
    assert sorted(map(tuple, files.read_captions(spark, str(tmp_path)).collect())) == expected
    assert sorted(map(tuple, media.caption_files(spark, f"{tmp_path}/*/*.vtt").collect())) == [x for x, c in zip(expected, sorted((f"v{i}", c) for i, c in enumerate(contents[:40])), strict=True) if c[1]]  # without empty files
    files.register(spark)
    small = spark.read.format("captions").option("maxPartitionBytes", 100).load(f"file://{tmp_path}")
    assert small.rdd.getNumPartitions() > 3 and small.count() == 40
    (tmp_path / "none").mkdir()
    assert files.read_captions(spark, str(tmp_path / "none")).count() == 0


def test_a_file_per_recording(spark, tmp_path):
    rows = [("a/b c", i, f"line {i}") for i in range(500)] + [("é", 1, "x"), ("é", 0, None), (None, 0, "lost")]
    d = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "video_id string, idx int, line string")
    path = str(tmp_path / "out")
    files.save_files(d, path, ["idx"])
    names = lambda: sorted(p.name for p in (tmp_path / "out").glob("part-*/*"))
    assert names() == ["%C3%A9.md", "a%2Fb%20c.md"] and not list((tmp_path / "out").glob("_staging-*")) and (tmp_path / "out" / "_SUCCESS").exists()
    assert next((tmp_path / "out").glob("part-*/a*")).read_text() == "".join(f"line {i}\n" for i in range(500)) and next((tmp_path / "out").glob("part-*/%C3*")).read_text() == "\nx\n"
    assert sorted(r.video_id for r in files.read_captions(spark, path, "*.md", by="stem").collect()) == ["a/b c", "é"]
    files.save_files(d.where("video_id = 'é'"), path, ["idx"])
    assert names() == ["%C3%A9.md", "%C3%A9.md", "a%2Fb%20c.md"]
    files.save_files(d.where("video_id = 'é'"), path, ["idx"], overwrite=True)
    assert names() == ["%C3%A9.md"]
    # a task that fails leaves what was there, and no staging
    bad = spark.createDataFrame([("z", 0, "a"), ("y", 1, "b"), ("z", 2, "c")], "video_id string, idx int, line string").coalesce(1).sortWithinPartitions("idx")
    with pytest.raises(Exception, match="not together"):
        bad.select("video_id", "line").write.format("recording_files").mode("overwrite").save(path)
    assert names() == ["%C3%A9.md"] and not list((tmp_path / "out").glob("_staging-*"))
    files.save_files(d.limit(0), str(tmp_path / "empty"), ["idx"])
    assert not list((tmp_path / "empty").glob("part-*"))
    with pytest.raises(Exception, match="STRING"):
        d.select("idx").write.format("recording_files").mode("append").save(path)


def test_a_report_line_by_line(spark):
    """All lines of one report, as written out by hand."""
    row = dict(video_id="v", source="s.mp4", audio_path=None, title="T", uploader="", duration=700.25, start=None, end=None, width=640, height=360, codec=None, mode="two-pass", n_frames=2, n_speech=1, n_scenes=3, two_pass=True, speech=True, scene_detect=True, fixed_rate=False)
    row |= dict(fps=0.1145, target=80, max_frames=80, threshold=27.0, resolution=512, n_large=1, ocr=True, n_text=1, n_segments=1, transcript_source=None, windows="0:00-0:10 (covering 10s of 700s)", work="/w", has_captions=True)
    schema = "video_id string, source string, audio_path string, title string, uploader string, duration double, start double, end double, width int, height int, codec string, mode string, n_frames int, n_speech int, n_scenes int, two_pass boolean, speech boolean, scene_detect boolean, fixed_rate boolean, fps double, target int, max_frames int, threshold double, resolution int, n_large int, ocr boolean, n_text int, n_segments int, transcript_source string, windows string, work string, has_captions boolean"
    quiet = row | dict(video_id="q", mode="fps", start=5.0, ocr=False, n_segments=0, windows=None, n_large=0, n_scenes=0, title=None, width=None)
    d = spark.createDataFrame([tuple(x[c.split()[0]] for c in schema.split(", ")) for x in (row, quiet)], schema)
    frames = spark.createDataFrame([("v", 1, "f1", 61.0, "[silent]", None), ("v", 0, "f0", 2.5, "[speech]", " a \n b "), ("q", 0, "f", 5.0, "[speech]", "t"), ("x", 0, "f", 5.0, "", "")], "video_id string, idx int, path string, timestamp_seconds double, tag string, text string")
    said = spark.createDataFrame([("v", 0, "[00:00] hi"), ("q", 0, "not shown")], "video_id string, seq long, line string")
    got = report.reports(d, frames, said).orderBy("video_id", "section", "idx").collect()
    v, q = ([x.line for x in got if x.video_id == k] for k in "vq")
    assert v[:13] == [
        "# chronoframe: video report", "", "- **Source:** s.mp4", "- **Title:** T", "- **Duration:** 11:40 (700.2s)", "- **Resolution:** 640x360 (unknown codec)",
        "- **Frames:** 2 extracted via two-pass (1 in speech windows, 1 outside; speech share 70%, 3 scenes informing pick, max 80, full mode)", "- **Frame size:** 512px wide (1 text-heavy frames upscaled to 1024px)", "- **OCR:** 1/2 frames had detected text (lang=spa+eng)",
        "- **Transcript:** 1 segments (via captions)", "- **Speech windows:** 0:00-0:10 (covering 10s of 700s)", "", report.LONG.replace("{}", "11"),
    ]
    assert v[13:] == ["", "## Frames", "", "Frames live at: `/w/frames`", "", report.VIEW, "", report.WITH_TEXT.replace("{}", "Spanish + English", 1).replace("{}", "1024"), "", "- `f0` (t=00:02) [speech] — OCR: a b", "- `f1` (t=01:01) [silent]", "", "## Transcript", "", "_Source: captions._", "", "```", "[00:00] hi", "```", "", "---", "_Work dir: `/w` — delete when done._"]
    assert q[4] == "- **Focus range:** 00:05 → 11:40 (695.2s)" and f"- **Frames:** 2 @ {0.1145:.3f} fps, focused mode (budget 80, max 80) — scene-detect found no cuts, fell back to fps" in q and "- **OCR:** disabled (`--no-ocr`)" in q
    assert "- `f` (t=00:05)" in q and "_No transcript lines fell inside 00:05 → 11:40._" in q and "not shown" not in q and {x.video_id for x in got} == {"v", "q"}


def test_fall_through_asks_once(spark):
    seen = spark.sparkContext.accumulator(0)
    d = spark.createDataFrame([(i, [float(i), i + 0.5]) for i in range(12)] + [(99, []), (None, [1.0])], "video_id long, m array<double>")

    def extract(moments):
        def fail(batches):
            for b in batches:
                seen.add(len(b))
                yield b[(b["mode"] == "c") & (b["video_id"] != 5) | (b["mode"] == "a") & (b["video_id"] < 3) & (b["idx"] == 1) | (b["mode"] == "b") & (b["video_id"] % 2 == 0)]

        return moments.mapInPandas(fail, moments.schema)

    ways = [stages.Stage("a", F.col("video_id") != 11, lambda x: stages.listed(x, F.col("m"))), stages.Stage("b", F.lit(True), lambda x: stages.listed(x, F.col("m"))), stages.Stage("c", F.lit(True), lambda x: stages.listed(x, F.col("m")))]
    frames, modes = stages.fall_through(d, ways, extract)
    assert {r.video_id: (r["mode"], r.frames) for r in modes.collect()} == {i: ("a", 1) if i < 3 else ("b", 2) if i % 2 == 0 else ("c", 0 if i == 5 else 2) for i in range(12)} | {99: ("c", 0)}
    assert sorted((r.idx, r.timestamp_seconds, r.path) for r in frames.where("video_id = 1").collect()) == [(1, 1.5, "frame_0002.jpg")]
    assert frames.count() == 3 + 4 * 2 + 4 * 2 and seen.value == 2 * (11 + 9 + 5)  # each recording at most once a stage
    scenes = spark.createDataFrame([("v", i, float(i), i + 1.0) for i in range(10)] + [("w", 0, 0.0, 1.0)], "video_id string, scene_no int, start double, end double")
    assert {r.video_id: r.moments for r in stages.scene_moments(scenes, 5).collect()} == {"v": [0.5, 2.5, 4.5, 7.5, 9.5], "w": [0.5]}
    assert {r.video_id: r.moments for r in stages.scene_moments(scenes, 1).collect()} == {"v": [5.5], "w": [0.5]} and stages.scene_moments(scenes, 0).count() == 0


def test_requests(spark):
    schema = "video_id int, source string, audio string, no_whisper boolean, backend string, question string, start string, end string, duration double"
    rows = [
        (1, "HTTPS://a.b/c", None, False, "claude", None, None, None, 9.0), (2, "/v/x.mp4", None, None, None, None, "0:01", "5", 9.0), (3, "/v/y.TXT", "/v/x.mp4", False, "claude", "", " ", None, None),
        (4, "/v/none.mp4", "/no.mp3", True, "gemini", " ", "-1", "x", 9.0), (5, "/v/x.mp4", None, False, "claude", None, "-1", None, 9.0), (6, "/v/x.mp4", None, False, "claude", None, "5", "5", 9.0), (7, "/v/x.mp4", None, False, "claude", None, "9", None, 9.0),
        (8, "/v/x.mp4", None, False, "claude", None, None, "-3", 9.0), (9, None, "", None, None, None, None, None, None), (10, "/v/x.mp4", None, False, "openrouter", "why", "9", None, 9.0), (11, "/v/x.mp4", None, False, "claude", None, "9", None, 0.0), (12, "/v/.mp4", None, False, "claude", None, None, None, 0.0),
    ]
    there = spark.createDataFrame([("/v/x.mp4",), ("/v/x.mp4",), ("/v/y.TXT",), ("/v/.mp4",)], "path string")
    accepted, rejected, counts = routing.routed(spark.createDataFrame(rows, schema), there)
    good = {r.video_id: r for r in accepted.collect()}
    assert sorted(good) == [1, 2, 3, 8, 10, 11, 12] and counts.get == {"requests": 12, "accepted": 7, "downloads": 1, "warnings": 2}
    assert (good[1].route, good[1].title, good[2].title, good[2].start_seconds, good[2].end_seconds) == ("download", None, "x.mp4", 1.0, 5.0)
    assert good[3].warning == ".txt is not a known video extension, proceeding anyway" and good[2].warning is None and good[12].warning.startswith(" is not")
    why = {}
    for r in rejected.orderBy("video_id", "at").collect():
        why.setdefault(r.video_id, []).append(r.reason)
    assert why == {4: [routing.BOTH_AUDIO, "--audio file not found: /no.mp3", "--backend gemini requires a question", "File not found: /v/none.mp4", "not a time: x"], 5: [routing.NEGATIVE], 6: [routing.REVERSED], 7: ["--start 9.0s is past end of video (9.0s)"], 9: ["File not found: "]}


def test_sql_functions_equal_columns(spark):
    sql.register(spark)
    times = ["45", "0:90", "1:02:03.5", "", "  ", None, "1:2:3:4", "1.5:00", "x", " 7 ", "1::2", "-3"]
    d = spark.createDataFrame([(t,) for t in times], "t string")
    assert spark.sql("SELECT parse_time(t) AS x FROM {d}", d=d).collect() == d.select(scalar.parse_time(F.col("t")).alias("x")).collect()
    assert spark.sql("SELECT format_time(parse_time(t)) AS x FROM {d}", d=d).collect() == d.select(scalar.format_time(scalar.parse_time(F.col("t"))).alias("x")).collect()
    words = spark.createDataFrame([("ABCDE FGHI",), ("ABCDE FGHIJ",), (None,), ("https://a",), ("HTTP://b/c",), ("ftp://a",), ("https:///x",)], "t string")
    assert spark.sql("SELECT is_url(t) AS u, is_significant(t) AS s FROM {w}", w=words).collect() == words.select(scalar.is_url(F.col("t")), scalar.is_significant(F.col("t"))).collect()
    r = random.Random(3)
    lines = ["", " \t", "00:00:01.005 --> 00:00:02.500 align:start", "00:00:03,015  -->\t01:00:04,000", "00:01.000 --> 00:02.000", "a", "a b", "<c>a</c>", "<i> </i>", "WEBVTT", "a b", "x 00:00:01.000 --> 00:00:02.000"]
    texts = spark.createDataFrame([(i, r.choice(["\n", "\r\n"]).join(r.choice(lines) for _ in range(r.randint(0, 25)))) for i in range(300)] + [(999, None)], "video_id long, value string")
    lateral = spark.sql("SELECT f.video_id, c.* FROM {f} f, LATERAL parse_vtt(f.value) c", f=texts)
    assert sorted(map(tuple, lateral.collect())) == sorted(map(tuple, captions.parse_vtt(texts).collect()))
    assert lateral.count() > 200


def test_white_space_of_answers(spark):
    """All white space goes, as in the speech services' answers; a segment of nothing else is none."""
    raw = ['{"segments":[{"start":0.125,"end":null,"text":"\\n\\t hi\\u00a0\\n"},{"start":1,"end":2,"text":"\\n\\u00a0"}],"text":"x"}', '{"segments":[{"text":"\\u2003"}],"text":"\\u00a0whole\\n"}', '{"text":" \\t"}', None]
    d = spark.createDataFrame([(i, j) for i, j in enumerate(raw)], "video_id int, json string")
    assert sorted(map(tuple, captions.normalised_response(d).collect())) == [(0, 0, 0.12, 0.0, "hi"), (1, 0, 0.0, 0.0, "whole")]


def test_stream_of_runs_equals_batch(spark, tmp_path):
    from chronoframe.streaming.runs import collapsed_runs

    r = random.Random(7)
    rows = [(v, i, float(i), i + 1.0, r.choice(["a", "a b", "a b c", "c"]), i) for v in range(6) for i in range(40)]
    schema = "video_id long, seq long, start double, end double, text string, at long"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    add = lambda part: spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds(F.col("at") + 1000)).coalesce(1).write.mode("append").parquet(source)
    add([x for x in rows if x[1] < 15])
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = collapsed_runs(stream, late="5 seconds", idle_seconds=100.0).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        q.processAllAvailable()
        add([x for x in rows if 15 <= x[1] < 30])
        q.processAllAvailable()
        # late: one row that is behind what is folded, one that is behind the watermark
        add([x for x in rows if x[1] >= 30] + [(0, 20, 0.0, 0.0, "late", 39), (1, 50, 0.0, 0.0, "old", 0)])
        q.processAllAvailable()
        open_ = spark.read.parquet(out).count()
        add([(77, 0, 0.0, 1.0, "clock", 5000)])  # the watermark moves on, and with it go the open runs
        q.processAllAvailable()
        add([(77, 1, 1.0, 2.0, "clock", 5001)])
        q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(out).where("video_id <> 77").collect()))
    expected = sorted(map(tuple, captions.collapse_runs(spark.createDataFrame(rows, schema)).select("video_id", "seq", "start", "end", "text").collect()))
    assert got == expected and open_ == len(expected) - 6


def test_large_files_are_dealt_out_in_few_groups(spark, tmp_path, monkeypatch):
    """The largest row alone, others together as far as they are no larger than it, and nothing between their exchange and what reads them."""
    monkeypatch.setattr(files, "_LARGE", 1000, raising=False)
    texts = {"a": "é" * 2000, "b": "b" * 2500, "c": "c" * 1200, "d%/é": "d" * 3000, **{f"n{i}": str(i) for i in range(20)}}
    files.save_files(spark.createDataFrame(list(texts.items()), "video_id string, line string"), str(tmp_path / "out"), ["line"])
    d = files.whole_files(spark, f"{tmp_path}/out/*/*.md", large=True)
    got = [[(r.video_id, r.value) for r in rows] for rows in d.rdd.glom().collect()]
    assert {k: v for rows in got for k, v in rows} == {k: v + "\n" for k, v in texts.items()} and sum(map(len, got)) == len(texts)
    large = [{k for k, v in rows if len(v.encode()) >= 1000} for rows in got]
    assert large == [{"a"}, {"c", "b"}, {"d%/é"}] or large == [{"a"}, {"d%/é"}, {"c", "b"}]
    plan = registry.queries()["text_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.startswith("Exchange shufflepartitionidpassthrough") and plan.count("Exchange") == 1


def test_text_maps_are_shuffled_once(spark, tmp_path):
    """Ties and a single entry included, whole objects; lines go to their files from where a window left them."""
    rows = [("a", i // 2, f"p{i}", f'x"{i}') for i in range(11)] + [("b", 5, None, None), (None, 1, "p", "x")]
    lines = report.text_map_lines(spark.createDataFrame(rows, "video_id string, idx long, path string, text string"))
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    files.save_files(lines, str(tmp_path / "out"), ["at"], extension="json", together=True)
    got = {p.stem: json.loads(p.read_text()) for p in (tmp_path / "out").glob("*/*.json")}
    assert got == {"a": {f"p{i}": f'x"{i}' for i in range(11)}, "b": {"": None}} and (tmp_path / "out" / "_SUCCESS").exists()
    assert next((tmp_path / "out").glob("*/b.json")).read_text() == '{\n  "": null\n}\n'
