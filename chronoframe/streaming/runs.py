"""Collapse of rolling captions over a stream: the open run of each recording is kept as state until a row or the clock ends it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_OUT = ["seq", "start", "end", "text"]


def folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Runs of rows in the order of seq: seq, start, end, text and last (the seq of their last row).

    A row joins the one before if it repeats its text or continues it after a space. Rows may be runs that are still open: last is theirs.
    """
    d = rows.sort_values("seq", kind="stable")
    before = [None, *d["text"][:-1]]
    new = [b is None or not (t == b or t.startswith(b + " ")) for t, b in zip(d["text"], before, strict=True)]
    return d.groupby(pd.Series(new, d.index).cumsum().to_numpy()).agg(seq=("seq", "first"), start=("start", "first"), end=("end", "last"), text=("text", "last"), last=("last", "last"))


class Runs(StatefulProcessor):
    """State: the open run and the seq of its last row. A row not after that seq is late and left out, as it may belong to runs that are already given out."""

    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "seq long, start double, end double, text string, last long")

    def _given(self, key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
        return runs[_OUT].assign(**{self.key: key[0]})[[self.key, *_OUT]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(rows))
        latest = max(timerValues.getCurrentWatermarkInMs(), int(d["ms"].max()))
        d = d[_OUT].assign(last=lambda x: x["seq"])
        if self.open.exists():
            held = pd.DataFrame([tuple(self.open.get())], columns=[*_OUT, "last"])
            d = pd.concat([held, d[d["seq"] > held["last"][0]]])
        runs = folded(d)
        tail = runs.iloc[-1]
        self.open.update((int(tail["seq"]), float(tail["start"]), float(tail["end"]), tail["text"], int(tail["last"])))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(latest + self.idle_ms)
        yield self._given(key, runs.iloc[:-1])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame([tuple(self.open.get())], columns=[*_OUT, "last"])
        self.open.clear()
        yield self._given(key, held)

    def close(self) -> None:
        pass


def collapsed_runs(segments: DataFrame, late: str = "10 seconds", idle_seconds: float = 60.0, key: str = "video_id") -> DataFrame:
    """key, seq, start, end, text: runs of a stream of segments, given out as soon as they end.

    segments: key, seq, start, end, text and `at` TIMESTAMP, when a segment was said; rows come about in the order of seq. A run ends with the first row that does
    not continue it, or once the watermark, `late` behind the latest `at`, is `idle_seconds` past the latest `at` of the recording's last batch. Rows older than the
    watermark and rows not after the last one folded are left out; null texts are empty ones. Needs the RocksDB state store.
    """
    d = segments.withWatermark("at", late).where(F.col(key).isNotNull() & F.col("seq").isNotNull()).select(key, "at", F.unix_millis("at").alias("ms"), F.col("seq").cast("long").alias("seq"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), F.coalesce("text", F.lit("")).alias("text"))
    schema = f"{key} {dict(d.dtypes)[key]}, seq long, start double, end double, text string"
    return d.groupBy(key).transformWithStateInPandas(statefulProcessor=Runs(key, int(idle_seconds * 1000)), outputStructType=schema, outputMode="Append", timeMode="EventTime")
