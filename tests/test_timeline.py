"""Golden cases, properties against plain folds, and every query against its SQL."""

import random
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.functions import scalar
from chronoframe.operators import budget, captions, frames, intervals, recognition, report, sampling, selection
from chronoframe.plans import registry
from chronoframe.sources import media

DATA = Path("/root/testdata/sf0.001")


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_times(spark):
    assert values(spark, scalar.parse_time(F.col("t")), [("45",), ("0:90",), ("1:02:03.5",), ("",), (None,), ("1:2:3:4",), ("1.5:00",), ("x",)], "t string") == [45, 90, 3723.5, None, None, None, None, None]
    assert values(spark, scalar.format_time(F.col("t")), [(0.5,), (2.5,), (59.5,), (3599.5,), (-3.0,), (None,)], "t double") == ["00:00", "00:02", "01:00", "1:00:00", "-1:59:57", None]
    assert values(spark, scalar.format_clock(F.col("t")), [(3725.0,)], "t double") == ["62:05"]
    assert values(spark, scalar.cue_stamp(F.col("t")), [(3725.9,)], "t double") == ["[62:05]"]
    assert values(spark, scalar.exact_round(2)(F.col("t")), [(2.675,), (1.005,), (0.125,), (None,)], "t double") == [2.67, 1.0, 0.12, None]


def test_texts(spark):
    assert values(spark, scalar.is_significant(F.col("t")), [("ABCDE FGHI",), ("ABCDE FGHIJ",), (None,)], "t string") == [False, True, False]
    urls = [("HTTPS://A.b",), ("http:///x",), ("-https://a",), ("ftp://a.b",), (None,)]
    assert values(spark, scalar.is_url(F.col("t")), urls, "t string") == [True, False, False, False, False]
    hosts = ["www.youtube.com", "m.youtube.com", "www.m.youtube.com", "youtu.be", "music.youtube.com", "youtube.com:443"]
    assert values(spark, scalar.is_video_host(F.col("t")), [(f"https://{h}/x",) for h in hosts], "t string") == [True] * 4 + [False] * 2
    words = [(["Hi,", " ", None, "x", "y"], ["96", "99", "80", "-1", "50"])]
    assert values(spark, recognition.confident_text(F.col("w"), F.col("c")), words, "w array<string>, c array<string>") == ["Hi, y"]
    assert values(spark, scalar.collapse_space(F.col("t")), [(" a \n b ",)], "t string") == ["a b"]


FULL = {0: (1, 1), 3: (2, 6), 5: (2, 10), 12: (1, 12), 30: (1, 30), 60: (40 / 60, 40), 61: (60 / 61, 60), 180: (60 / 180, 60), 181: (80 / 181, 80), 600: (80 / 600, 80), 601: (80 / 601, 80)}
FOCUS = {0: (2, 2), 3: (2, 6), 5: (2, 10), 12: (2, 24), 30: (2, 60), 60: (80 / 60, 80), 61: (80 / 61, 80), 180: (80 / 180, 80), 601: (80 / 601, 80)}


@pytest.mark.parametrize("function, expected", [(budget.full_budget, FULL), (budget.focus_budget, FOCUS)])
def test_budgets(spark, function, expected):
    fps, n = function(F.col("d"), F.lit(80))
    rows = spark.createDataFrame([(float(d),) for d in expected], "d double").select("d", fps.alias("fps"), n.alias("n")).collect()
    assert {r.d: (pytest.approx(r.fps), r.n) for r in rows} == {float(k): v for k, v in expected.items()}


def test_sampling(spark):
    rows = [(0.0, 9.0, [], 1), (0.0, 10.0, [], 3), (0.0, 10.0, [5.0], 2), (0.0, 10.0, [1.0, 5.0, 9.0], 2), (0.0, 10.0, [1.0, 5.0, 9.0], 1), (0.0, 1.0, [0.5], 2), (0.0, 1.0, [], 0)]
    got = values(spark, sampling.picked(F.col("s"), F.col("e"), F.col("m"), F.col("b")), rows, "s double, e double, m array<double>, b int")
    assert got == [[3.0], [2.0, 4.0, 6.0], [2.5, 5.0], [1.0, 9.0], [5.0], [0.5, 0.5], []]
    assert values(spark, sampling.thin_indices(F.col("n"), F.col("m")), [(10, 5), (10, 1), (3, 9), (0, 2)], "n int, m int") == [[0, 2, 4, 7, 9], [5], [0, 1, 2], []]
    assert values(spark, sampling.thin_indices(F.col("n"), F.col("m"), "first"), [(10, 1)], "n int, m int") == [[0]]


def test_two_pass_plan(spark):
    r = spark.createDataFrame([("v", 0.0, 30.0, 10), ("q", 0.0, 9.0, 2), ("none", 0.0, 0.0, 5)], "video_id string, lo double, hi double, max_frames long")
    w = spark.createDataFrame([("v", 1, 0.0, 10.0), ("v", 2, 14.0, 20.0)], "video_id string, win long, start double, end double")
    m = spark.createDataFrame([], "video_id string, midpoint double")
    got = {x.video_id: x for x in sampling.two_pass_plan(r, w, m).collect()}
    assert got["v"].timestamps == [1.667, 3.333, 5.0, 6.667, 11.333, 15.2, 16.4, 17.6, 22.5, 25.0]
    assert (got["v"].speech_count, got["v"].non_speech_count, got["v"].speech_total_seconds, got["v"].non_speech_total_seconds) == (7, 3, 16.0, 14.0)
    assert got["q"].timestamps == [3.0, 6.0] and got["none"].timestamps == []


VTT = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\n<c>hello</c>\nworld\n\n00:03.000 --> 00:04.000\nno hours\n\n00:00:05,000 --> 00:00:06,000\n\n"


def test_captions(spark):
    files = spark.createDataFrame([("v", VTT)], "video_id string, value string")
    assert [tuple(r)[2:] for r in captions.parse_vtt(files).collect()] == [(1.0, 2.5, "hello world")]
    rows = [("v", i, *x) for i, x in enumerate([(0, 1, "a"), (1, 2, "a b"), (2, 3, "a b"), (3, 4, "ab"), (4, 5, "a")])] + [("w", 0, 0, 5, "x"), ("w", 1, 1, 2, "x")]
    got = captions.collapse_runs(spark.createDataFrame(rows, "video_id string, seq long, start long, end long, text string")).orderBy("video_id", "seq").collect()
    assert [tuple(r)[2:] for r in got] == [(0, 3, "a b"), (3, 4, "ab"), (4, 5, "a"), (0, 2, "x")]
    segs = spark.createDataFrame([("v", 0, 0.0, 5.9, "hi", "Speaker A"), ("w", 0, 0.0, 1.0, "hi", None)], media.SEGMENTS)
    assert {r.video_id: r.transcript for r in captions.transcripts(segs).collect()} == {"v": "[Speaker A] (0:00-0:05) hi", "w": "[00:00] hi"}


def fold(rows, gap):
    out = []
    for s, e in sorted(rows):
        if out and s - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def test_islands_and_gaps_against_a_fold(spark):
    random.seed(3)
    data = {v: [(s := random.randint(0, 60), s + random.randint(0, 9)) for _ in range(random.randint(1, 12))] for v in range(60)}
    segs = spark.createDataFrame([(v, i, s, e) for v, rows in data.items() for i, (s, e) in enumerate(rows)], "video_id long, seq long, start long, end long")
    w = intervals.islands(segs, F.lit(2))
    ranges = spark.createDataFrame([(v, 10, 50) for v in data], "video_id long, lo long, hi long")
    clip = intervals.clipped(w, ranges)
    g = intervals.gaps(clip, ranges)
    by = lambda df: {v: sorted((r.start, r.end) for r in df.where(f"video_id = {v}").collect()) for v in list(data)[:15]}
    got_w, got_c, got_g = by(w), by(clip), by(g)
    for v in list(data)[:15]:
        expected = [tuple(x) for x in fold(data[v], 2)]
        assert got_w[v] == expected
        cut = [(max(s, 10), min(e, 50)) for s, e in expected if min(e, 50) > max(s, 10)]
        assert got_c[v] == cut
        assert sorted(got_c[v] + got_g[v])[0][0] == 10 and sum(e - s for s, e in got_c[v] + got_g[v]) == 40


def test_allocation(spark):
    rows = [("t", i, 0.0, float(n), 8) for i, n in enumerate([4, 4, 1, 3])] + [("u", 0, 0.0, 10.0, 5), ("u", 1, 0.0, 6.0, 5), ("u", 2, 0.0, 10.0, 5)]
    got = budget.allocated(spark.createDataFrame(rows, "video_id string, win long, start double, end double, budget long")).groupBy("video_id").agg(F.sum("frames").alias("n"), F.min("frames").alias("least")).collect()
    assert {r.video_id: (r.n, r.least >= 1) for r in got} == {"t": (8, True), "u": (5, True)}


def test_overlap_and_summary(spark):
    segs = spark.createDataFrame([(0.0, 2.0), (4.0, 9.0), (0.0, 1.99), (4.01, 5.0)], "start double, end double")
    assert sorted(tuple(r) for r in intervals.overlapping(segs, F.lit(2.0), F.lit(4.0)).collect()) == [(0.0, 2.0), (4.0, 9.0)]
    w = [([(0.0, 10.0), (14.0, 20.0)],), ([],)]
    got = values(spark, report.window_summary(F.col("w"), F.lit(16.0), F.lit(30.0)), w, "w array<struct<start:double,end:double>>")
    assert got == ["0:00-0:10, 0:14-0:20 (covering 16s of 30s)", "(none)"]


def test_selection(spark):
    f = spark.createDataFrame([("v", "video.es.vtt"), ("v", "video.en.vtt"), ("v", "video.en-US.vtt"), ("v", "a.avi"), ("v", "b.mkv")], "video_id string, name string")
    assert selection.subtitle(f).first().name == "video.en-US.vtt"
    assert selection.video(f).first().name == "b.mkv"
    faults = values(spark, selection.scope_fault(F.lit(10.0), F.col("s"), F.col("e")), [(-1.0, None), (3.0, 2.0), (11.0, 12.0), (1.0, 2.0), (None, -2.0)], "s double, e double")
    assert faults == ["start is negative", "end is not after start", "start is past the end", None, None]


def test_sources_and_adapters(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "video.en.vtt").write_text(VTT)
    files = media.caption_files(spark, str(tmp_path / "*" / "*.vtt"))
    assert [(r.video_id, r.name, r.value) for r in files.collect()] == [("v1", "video.en.vtt", VTT)]
    assert media.local_files(spark, str(tmp_path / "*" / "*.vtt")).first().known is False
    requests = spark.createDataFrame([("v",)], "video_id string")
    assert media.adapted(requests, media.NoResults(media.SCENES)).collect() == []
    got = values(spark, media.info(F.col("j"), F.lit("src")), [("not json",), (None,)], "j string")
    assert [g.url for g in got] == ["src", "src"]


def test_payload(spark):
    frames = spark.createDataFrame([("v", 0, bytearray(b"x")), ("v", 1, None), ("w", 0, None)], "video_id string, idx int, content binary")
    prompts = spark.createDataFrame([("v", "why?", None), ("w", "why?", None)], "video_id string, question string, transcript string")
    rows = report.chat_payload(frames, prompts).collect()
    assert [r.video_id for r in rows] == ["v"] and rows[0].json.startswith('[{"type":"text","text":"2 frames') and "data:image/jpeg;base64,eA==" in rows[0].json


def test_reports_are_rows(spark):
    """A repeated and a null path keep their entries, and scenes keep their fields."""
    texts = spark.createDataFrame([("v", "a", "x"), ("v", "a", "y"), ("v", None, "z"), ("w", "b", '"')], "video_id string, path string, text string")
    assert sorted((r.video_id, r.path, r.json) for r in report.text_map(texts).collect()) == [("v", "", '{"":"z"}'), ("v", "a", '{"a":"x"}'), ("v", "a", '{"a":"y"}'), ("w", "b", '{"b":"\\""}')]
    scenes = spark.createDataFrame([("v", 0, 0.0, 2.0), ("v", 1, 2.0, 4.0)], "video_id string, scene_no int, start double, end double")
    assert [r.json for r in report.scene_report(scenes).orderBy("scene_no").collect()] == ['{"scene_no":0,"start":0.0,"end":2.0,"midpoint":1.0}', '{"scene_no":1,"start":2.0,"end":4.0,"midpoint":3.0}']


def test_frames(spark):
    times = [(2.675,), (1.005,), (0.125,), (0.375,), (12.344999,), (None,)]
    assert values(spark, frames.rounded_time(F.col("t")), times, "t double") == [2.67, 1.0, 0.12, 0.38, 12.34, None]
    asked = spark.createDataFrame([("a", 0.5), ("a", 2.675), ("a", 9.0), ("b", None)], "video_id string, at double")
    done = spark.createDataFrame([("a", 0.5), ("a", 9.0), ("b", 9.0)], "video_id string, at double")
    assert sorted(frames.at_moments(asked, done).collect()) == [("a", 0, 0.5, "frame_0001.jpg"), ("a", 2, 9.0, "frame_0003.jpg")]
    scores = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 27.0), ("a", 2.0, None), ("a", 3.0, 26.9), ("b", 0.0, 99.0), (None, None, 99.0)], "video_id string, at double, score double")
    assert sorted(frames.scenes_of(scores).collect()) == [("a", 0, 0.0, 1.0), ("a", 1, 1.0, 3.0)]
    many = spark.createDataFrame([("a", 0.0, 2.0, 250), ("b", 0.0, 2.0, 0)], "video_id string, start double, fps double, frames int")
    assert frames.at_fixed_rate(many, ["video_id"]).groupBy("video_id").count().collect() == [("a", budget.MAX_FRAMES)]


def test_chain_and_label(spark):
    attempts = spark.createDataFrame([("a", "x", None), ("a", "y", []), ("a", "z", ["s"]), ("b", "x", ["s"]), ("c", "w", ["s"]), ("d", "z", None)], "video_id string, model string, segments array<string>")
    assert sorted(frames.by_chain(attempts, ["x", "x", "y", "z"]).collect()) == [("a", "y", []), ("b", "x", ["s"])]
    rows = [("local", "big", True, True), ("assemblyai", None, True, False), ("groq", None, None, False)]
    label = frames.backend_label(F.col("b"), F.col("m"), F.col("d"), F.col("s"))
    assert values(spark, label, rows, "b string, m string, d boolean, s boolean") == ["whisper (local, big, --audio)", "whisper (assemblyai, diarized)", "whisper (groq)"]


def test_stream_equals_batch(spark, tmp_path):
    from chronoframe.streaming.windows import activity_windows

    rows = spark.sql("SELECT id % 3 AS video_id, timestamp_micros(id * id * 1000000) AS at, 1.5D AS seconds FROM range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in activity_windows(rows, "30 seconds").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = activity_windows(stream, "30 seconds", late="0 seconds").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    closed = {tuple(r) for r in spark.table("windows").collect()}
    assert closed and closed <= batch


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, views, name):
    got = registry.queries()[name](spark, str(DATA))
    rows = got.toPandas()
    if name not in registry.oracle_sql():
        assert len(rows)
        return
    expected = views.execute(registry.oracle_sql()[name]).df()
    columns = sorted(rows.columns)
    assert columns == sorted(expected.columns)
    plain = lambda v: None if pd.isna(v) else float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    key = lambda df: sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).values.tolist()), key=str)
    assert key(rows) == key(expected)
