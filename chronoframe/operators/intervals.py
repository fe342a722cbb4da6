"""Interval operators over tables keyed by recording: overlap, merging, clipping, gaps, point-in-interval joins.

Starts and ends may be of any numeric type; BIGINT microseconds keep sums and comparisons exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.operators.prefix import dealt, running


def overlapping(segments: DataFrame, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Segments that touch [lo, hi], ends included, unclipped; a null bound is open."""
    out = segments
    if lo is not None:
        out = out.where(lo.isNull() | (F.col("end") >= lo))
    if hi is not None:
        out = out.where(hi.isNull() | (F.col("start") <= hi))
    return out


def islands(segments: DataFrame, gap, key: str = "video_id", parts: int | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """key, win, start, end, n: segments merged while the next begins at most `gap` after the latest end so far.

    `more` are further aggregates of a window's segments. With `parts`, rows are dealt out in so many ranges, for recordings too large for one task.
    """
    merged = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), *more]
    rows = segments if more else segments.select(key, "start", "end", "seq")
    if parts is not None:
        order = ["start", "seq"]
        d = running(dealt(rows, key, order, parts), key, order, F.col("end"), "latest")
        new = F.col("latest").isNull() | (F.col("start") - F.col("latest") > gap)
        numbered = running(d.withColumn("new", new.cast("long")), key, order, F.col("new"), "win", F.sum, current=True)
        return numbered.groupBy(key, "win").agg(*merged)
    w = Window.partitionBy(key).orderBy("start", "seq")
    latest = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = latest.isNull() | (F.col("start") - latest > gap)
    marked = rows.withColumn("new", new.cast("int"))
    numbered = marked.withColumn("win", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long"))
    return numbered.groupBy(key, "win").agg(*merged)


def clipped(windows: DataFrame, ranges: DataFrame, key: str = "video_id") -> DataFrame:
    """Windows cut to the key's lo and hi (null is open); what has no length left goes."""
    lo, hi = F.col("lo"), F.col("hi")
    cut = windows.join(ranges, key).withColumn("start", F.greatest("start", lo)).withColumn("end", F.least("end", hi))
    return cut.where((lo.isNull() & hi.isNull()) | (F.col("end") > F.col("start")))


def gaps(windows: DataFrame, ranges: DataFrame, key: str = "video_id", parts: int | None = None) -> DataFrame:
    """key, start, end of what the windows leave of [lo, hi]. Windows are expected within their range; those of keys without a range are left out.

    With `parts`, rows are dealt out in so many ranges, for recordings too large for one task.
    """
    ends = ranges.select(key, F.col("hi").alias("start"), F.col("hi").alias("end"))
    walked, order = windows.select(key, "start", "end").unionByName(ends), ["start", "end"]
    if parts is None:
        walked = walked.withColumn("latest", F.max("end").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    else:
        walked = running(dealt(walked, key, order, parts), key, order, F.col("end"), "latest")
    begin = F.greatest(F.col("lo"), F.col("latest"))
    return walked.join(ranges.select(key, "lo"), key).where(F.col("start") > begin).select(key, begin.alias("start"), F.col("start").alias("end"))


def totals(windows: DataFrame, ranges: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """key, covered; at most the range's length where ranges are given."""
    out = windows.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    if ranges is not None:
        out = out.join(ranges, key).select(key, F.least("covered", F.col("hi") - F.col("lo")).alias("covered"))
    return out


def with_midpoints(scenes: DataFrame) -> DataFrame:
    return scenes.withColumn("midpoint", (F.col("start") + F.col("end")) / 2)


def _gridded(points: DataFrame, windows: DataFrame, at: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with `_cell`: a point lies in one cell of its key's grid, a window in every cell that it touches.

    A key's cells are as wide as its windows are apart on average, or long if they are longer: all windows of a key together lie in
    at most three times as many cells, and a point meets the windows of its cell only. Large keys are dealt out by cell.
    """
    w = windows.withColumns({"_from": F.col("start").cast("double"), "_to": F.col("end").cast("double")}).where(F.col("_to") >= F.col("_from"))
    cell = F.greatest((F.max("_to") - F.min("_from")) / F.count("*"), F.sum(F.col("_to") - F.col("_from")) / F.count("*"))
    grid = w.groupBy(F.col(key).alias("_key")).agg(F.min("_from").alias("_origin"), F.when(cell > 0, cell).otherwise(F.lit(1.0)).alias("_width"))
    place = lambda x: F.floor((x - F.col("_origin")) / F.col("_width"))
    held = w.join(grid, w[key] == grid["_key"]).withColumn("_cell", F.explode(F.sequence(place(F.col("_from")), place(F.col("_to"))))).drop("_key", "_origin", "_width", "_from", "_to")
    return points.join(grid, points[key] == grid["_key"], "left").withColumn("_cell", place(F.col(at).cast("double"))).drop("_key", "_origin", "_width"), held


def points_in_windows(points: DataFrame, windows: DataFrame, at: str, key: str = "video_id", how: str = "inner") -> DataFrame:
    """One row per point and window that holds it, ends included, with win, win_start and win_end.

    how: "left" keeps the other points too, with nulls; "left_semi" gives each point once if any window holds it, without the window's columns;
    "left_anti" those that none holds. A null key, point or bound matches nothing.
    """
    p, w = _gridded(points, windows.select(key, "win", "start", "end"), at, key)
    w = w.select(F.col(key).alias("_key"), F.col("_cell").alias("_at"), "win", F.col("start").alias("win_start"), F.col("end").alias("win_end"))
    return p.join(w, (p[key] == w["_key"]) & (p["_cell"] == w["_at"]) & F.col(at).between(w["win_start"], w["win_end"]), how).drop("_key", "_cell", "_at")


def points_away(points: DataFrame, others: DataFrame, at: str, other_at: str, tolerance: str, key: str = "video_id", parts: int | None = None) -> DataFrame:
    """The points farther than their own tolerance from every one of the key's others; null keys, times and tolerances are near nothing.

    Points and others are walked in one order, up and down: if the nearest other on either side is too far, all are. With `parts`, rows are dealt
    out in so many ranges, for recordings too large for one task.
    """
    point = F.struct(*points.columns)
    known = others.where(F.col(key).isNotNull() & F.col(other_at).isNotNull())
    rows = known.select(key, F.col(other_at).alias("_t"), F.lit(0).alias("_kind"), F.lit(None).cast(points.select(point).dtypes[0][1]).alias("_point"))
    rows = rows.unionByName(points.select(key, F.col(at).alias("_t"), F.lit(1).alias("_kind"), point.alias("_point")))
    other = F.when(F.col("_kind") == 0, F.col("_t"))
    for time, fold, name in ((F.col("_t").asc(), F.max, "_before"), (F.col("_t").desc(), F.min, "_after")):
        order = [time, F.col("_kind")]
        if parts is None:
            rows = rows.withColumn(name, fold(other).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        else:
            rows = running(dealt(rows, key, order, parts), key, order, other, name, fold, current=True)
    near = lambda o: F.coalesce(F.abs(F.col("_t") - F.col(o)) <= F.col("_point")[tolerance], F.lit(False))
    return rows.where((F.col("_kind") == 1) & ~near("_before") & ~near("_after")).select("_point.*")


def tagged(points: DataFrame, windows: DataFrame, at: str, key: str = "video_id", inside: str = "[speech]", outside: str = "[silent]", parts: int | None = None) -> DataFrame:
    """Points with a tag that tells whether a window holds them; rows are never multiplied.

    Points and starts of windows are walked in one order: a window holds a point if the latest end among those begun so far is not before
    it. With `parts`, rows are dealt out in so many ranges, for recordings too large for one task.
    """
    t = F.struct(*points.columns)
    starts = windows.where(F.col(key).isNotNull()).select(key, F.col("start").cast("double").alias("_t"), F.lit(0).alias("_kind"), F.col("end").cast("double").alias("_end"), F.lit(None).cast(points.select(t).dtypes[0][1]).alias("_point")).where("_t is not null")
    asked = points.select(key, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_end"), t.alias("_point"))
    rows, order = starts.unionByName(asked), ["_t", "_kind"]
    if parts is None:
        latest = F.max("_end").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        walked = rows.withColumn("_latest", latest)
    else:
        walked = running(dealt(rows, key, order, parts), key, order, F.col("_end"), "_latest", current=True)
    hit = F.coalesce(F.col("_latest") >= F.col("_t"), F.lit(False))
    return walked.where("_kind = 1").select("_point.*", F.when(hit, F.lit(inside)).otherwise(F.lit(outside)).alias("tag"))


def away_from(points: Column, others: Column, tolerance: Column) -> Column:
    """The points of an array farther than the tolerance from every one of the others."""
    return F.filter(points, lambda p: F.forall(others, lambda o: F.abs(p - o) > tolerance))
