"""Queries against their SQL on few rows of a kind that the driver tables rarely hold."""

import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import neighbours
from chronoframe.operators import frames
from chronoframe.plans import registry
from chronoframe.sources import files

START = datetime.datetime(2024, 1, 1)
#: event_id, hours, user_id, event_type, minutes: windows without length, alone and beside others, with and without a scene; an unknown user.
EVENTS = [
    (0, 0, 1, "purchase", 0.0), (1, 9, 1, "view", 30.0), (2, 18, 1, "view", 0.0), (3, 27, 1, "purchase", 90.0), (4, 28, 1, "purchase", 5.0), (5, 36, 1, "purchase", 0.0),
    (6, 0, 2, "view", 10.0), (7, 9, 2, "purchase", 0.0), (8, 9, 2, "purchase", 0.0), (9, 20, 2, "view", 1.0), (10, 0, None, "view", 3.0),
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, '{}')", [(i, START + datetime.timedelta(hours=h), u, kind, m) for i, h, u, kind, m in EVENTS])
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder, con


def rows_of(frame, columns):
    return sorted((tuple(None if pd.isna(x) else x for x in r) for r in frame[columns].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", ["window_pick", "two_pass_plan"])
def test_windows_without_length(spark, events, name):
    folder, con = events
    got, expected = registry.queries()[name](spark, str(folder)).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert len(expected) and rows_of(got, list(expected.columns)) == rows_of(expected, list(expected.columns))


@pytest.mark.parametrize("kind", ["queries elsewhere", "lengths of all sizes", "far from zero", "copies of one code"])
def test_nearest_on_other_rows(spark, kind):
    """Queries that lie where few rows do, rows of very different lengths or far off, more equal codes than are reranked at first."""
    rng = np.random.default_rng(5)
    z, centres = rng.normal(size=(4000, 32)), rng.normal(size=(20, 32))
    if kind == "queries elsewhere":
        x = z * 0.05 + centres[rng.integers(0, 20, 4000)]
        x[::100] = z[::100]
    elif kind == "lengths of all sizes":
        x = z * np.exp(2 * rng.normal(size=(4000, 1)))
    elif kind == "far from zero":
        x = z + 1e9
    else:
        x = z * np.array([1.0, 1e-6])[rng.integers(0, 2, 4000)][:, None] + centres[0]
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(4000), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    found = neighbours.search(rows, F.col("vec_id") % 100 == 0).toPandas().groupby("query_id")["vec_id"].apply(set)
    hits = 0
    for q in range(0, 4000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.97 * 400


def test_whole_files(spark, tmp_path):
    """Files come back as they were written, with names that dots and other signs are part of; small ones together, a large one alone."""
    texts = {"a.b": ["é", "漢"], "x/y z%": [""], "large": ["0123456789" * 600_000], **{f"n{i}": [str(i)] for i in range(30)}}
    rows = spark.createDataFrame([(k, i, line) for k, lines in texts.items() for i, line in enumerate(lines)], "video_id string, idx int, line string")
    files.save_files(rows, str(tmp_path / "out"), ["idx"])
    got = {r.video_id: r.value for r in files.whole_files(spark, f"{tmp_path}/out/*/*.md").collect()}
    assert got == {k: "\n".join(lines) + "\n" for k, lines in texts.items()}


def test_frame_times_are_generated_code(spark):
    rows = spark.createDataFrame([("a", 2.675, 2.0, 3), ("b", 0.0, 2.0, 0), ("c", None, 2.0, 1)], "video_id string, start double, fps double, frames int")
    got = frames.at_fixed_rate(rows, ["video_id"])
    assert sorted(got.collect(), key=str) == [("a", 0, 2.67, "frame_0001.jpg"), ("a", 1, 3.17, "frame_0002.jpg"), ("a", 2, 3.67, "frame_0003.jpg"), ("c", 0, None, "frame_0001.jpg")]
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    assert [r[0] for r in spark.range(9998, 10001).select(frames.frame_name(F.col("id"))).collect()] == ["frame_9999.jpg", "frame_10000.jpg", "frame_10001.jpg"]
