"""Which moments to sample: even spacing, thinning, picks within an interval, and the plan weighted toward speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.functions.scalar import bound, exact_round
from chronoframe.operators.budget import SPEECH_SHARE, shares, speech_and_silence
from chronoframe.operators.intervals import away_from

_NONE = "array<double>"


def evenly_spaced(start: Column, end: Column, n: Column) -> Column:
    """n points that cut [start, end] into n + 1 equal parts; none if n < 1 or the interval is empty or has no known bounds."""
    step = (end - start) / (n + 1)
    points = F.transform(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), lambda i: (start + step * i).cast("double"))
    return F.when((n == 1) & (end > start), F.array(((start + end) / 2).cast("double"))).when((n > 1) & (end > start), points).otherwise(F.array().cast(_NONE))


def thin_indices(n: Column, m: Column, single: str = "middle") -> Column:
    """Positions of m of n ordered items, first and last included; a single one is the middle or the first."""
    one = F.floor(n / 2).cast("int") if single == "middle" else F.lit(0)
    many = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(2)) - 1), lambda i: F.rint(i * ((n - 1) / (F.greatest(m, F.lit(2)) - 1))).cast("int")))
    every = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    return F.when((m <= 0) | (n <= 0), F.array().cast("array<int>")).when(m >= n, every).when(m == 1, F.array(one)).otherwise(many)


def thinned(items: Column, m: Column, single: str = "middle") -> Column:
    return F.transform(thin_indices(F.size(items), m.cast("int"), single), lambda i: F.get(items, i))


def picked(start: Column, end: Column, midpoints: Column, budget: Column, instants: bool = False) -> Column:
    """`budget` moments of an interval: its scene midpoints, thinned if there are too many, else topped up with evenly spaced points.

    Extra points come from one more candidate than the budget, farther than max(0.5, 5 %) from all midpoints, first ones first; if
    these are too few, as many evenly spaced points are taken regardless of midpoints. An interval without length has no moments, or with
    `instants` those of its midpoints.
    """
    tolerance = F.greatest(F.lit(0.5), (end - start) * 0.05)

    def topped_up(mids: Column) -> Column:
        need = (budget - F.size(mids)).cast("int")
        far = away_from(evenly_spaced(start, end, budget + 1), mids, tolerance)
        extra = lambda f: F.when(F.size(f) >= need, F.slice(f, F.lit(1), F.greatest(need, F.lit(0)))).otherwise(evenly_spaced(start, end, need))
        return F.when(F.size(mids) >= budget, thinned(mids, budget)).otherwise(F.array_sort(F.concat(mids, bound(far, extra))))

    mids = F.array_sort(F.filter(midpoints, lambda m: m.between(start, end)))
    none = (budget <= 0) if instants else (budget <= 0) | (end <= start)
    return F.when(none, F.array().cast(_NONE)).otherwise(bound(mids, topped_up))


def two_pass_plan(ranges: DataFrame, windows: DataFrame, midpoints: DataFrame, share: float = SPEECH_SHARE, key: str = "video_id", instants: bool = False) -> DataFrame:
    """Moments for each recording, more of them in speech.

    ranges: key, lo, hi, max_frames. windows: key, start, end, disjoint, within the range. midpoints: key, midpoint. All in seconds.
    Returns key, timestamps, speech_count, non_speech_count, speech_total_seconds, non_speech_total_seconds; an empty
    range or a budget below 1 gives an empty plan, a range without speech evenly spaced moments that are not rounded. A window without length has no moments, or with `instants` its start.

    A recording's windows are one array, folded into gaps and shares of the budget. Its pieces and midpoints are then rows again: as pieces
    tile the range, a midpoint lies in the last piece begun, and in the one or two before that end where it is: two, if one of them has no length.
    """
    pair = "array<struct<start:double,end:double>>"
    held = windows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))).alias("held"))
    d = ranges.select(key, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.col("max_frames").cast("long").alias("most")).join(held, key, "left")
    usable = (F.col("most") > 0) & (F.col("hi") > F.col("lo"))
    d = d.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("held", F.when(F.col("usable") & F.col("held").isNotNull(), F.col("held")).otherwise(F.array().cast(pair)))
    ends = F.concat("held", F.array(F.struct(F.col("hi").alias("start"), F.col("hi").alias("end"))))
    gap = F.transform(ends, lambda w, i: F.struct(F.when(i == 0, F.col("lo")).otherwise(F.greatest("lo", F.get("held", i - 1)["end"])).alias("start"), w["start"].alias("end")))
    d = d.withColumn("gaps", F.when(F.col("usable"), F.filter(gap, lambda g: g["end"] > g["start"])).otherwise(F.array().cast(pair)))
    lengths = lambda name: F.transform(name, lambda x: x["end"] - x["start"])
    total = lambda name: F.aggregate(lengths(name), F.lit(0.0), lambda a, x: a + x)
    d = d.withColumns({"speech_len": F.least(total("held"), F.greatest(F.col("hi") - F.col("lo"), F.lit(0.0))), "silent_len": total("gaps")})
    speech, silent = speech_and_silence(F.col("most"), F.col("speech_len"), F.col("silent_len"), share)
    d = d.withColumns({"n_speech": F.when(F.col("usable"), speech).otherwise(0), "n_silent": F.when(F.col("usable"), silent).otherwise(0)})
    d = d.withColumns({"a": shares(lengths("held"), F.col("speech_len"), F.col("n_speech")), "b": shares(lengths("gaps"), F.col("silent_len"), F.col("n_silent"))})
    side = lambda name, frames: F.zip_with(name, frames, lambda x, n: F.struct(x["start"].alias("start"), x["end"].alias("end"), n.alias("frames")))
    none = F.array().cast("array<struct<start:double,end:double,frames:bigint>>")
    pieces = F.array_sort(F.concat(side("held", "a"), F.when(F.col("n_silent") > 0, side("gaps", "b")).otherwise(none)))
    d = d.withColumn("pieces", F.when(F.col("n_speech") > 0, F.filter(pieces, lambda p: p["end"] >= p["start"] if instants else p["end"] > p["start"])).otherwise(none))
    # pieces by their start, each with the ends of the two before, and midpoints, in one walk
    numbered = F.transform("pieces", lambda p, i: F.struct(p["start"].alias("t"), i.alias("n"), p.alias("piece"), F.get("pieces", i - 1)["end"].alias("before"), F.get("pieces", i - 2)["end"].alias("earlier")))
    # the outer form, as a filter that a plain explode implies would be pushed below all that makes the array, and make it many times
    begun = d.select(key, F.explode_outer(numbered).alias("p")).where("p is not null").select(key, "p.t", F.lit(0).alias("kind"), "p.n", "p.piece", "p.before", "p.earlier")
    at = midpoints.where(F.col("midpoint").isNotNull() & F.col(key).isNotNull()).select(key, F.col("midpoint").cast("double").alias("t"), F.lit(1).alias("kind"), *[F.lit(None).cast(begun.schema[c].dataType).alias(c) for c in ("n", "piece", "before", "earlier")])
    walk = Window.partitionBy(key).orderBy("t", "kind", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("kind") == 0, F.struct("n", F.col("piece.end").alias("end"), "before", "earlier")), ignorenulls=True).over(walk)
    walked = begun.unionByName(at).withColumn("last", last)
    met = [F.when(F.col("t") <= F.col("last.end"), F.col("last.n")), F.when(F.col("t") == F.col("last.before"), F.col("last.n") - 1), F.when(F.col("t") == F.col("last.earlier"), F.col("last.n") - 2)]
    own = F.when(F.col("kind") == 0, F.array("n")).otherwise(F.filter(F.array(*met), lambda x: x.isNotNull()))
    by_piece = walked.select(key, "kind", "t", "piece", F.explode(own).alias("n")).groupBy(key, "n").agg(F.max("piece").alias("piece"), F.collect_list(F.when(F.col("kind") == 1, F.col("t"))).alias("mids"))
    moments = picked(F.col("piece.start"), F.col("piece.end"), F.col("mids"), F.col("piece.frames"))
    chosen = by_piece.select(key, F.when(F.col("piece.end") > F.col("piece.start"), moments).otherwise(F.array("piece.start")).alias("t"))
    listed = chosen.groupBy(key).agg(F.flatten(F.collect_list("t")).alias("t")).select(key, F.array_sort(F.array_distinct(F.transform("t", exact_round(3)))).alias("all"))
    out = d.join(listed, key, "left").withColumn("all", F.coalesce("all", F.array().cast(_NONE)))
    quiet = F.col("usable") & (F.col("n_speech") == 0)
    out = out.withColumn("timestamps", F.when(quiet, evenly_spaced(F.col("lo"), F.col("hi"), F.col("most"))).otherwise(thinned(F.col("all"), F.col("most"), "first")))
    inside = F.when(quiet, F.lit(0)).otherwise(F.size(F.filter("timestamps", lambda t: F.exists("held", lambda x: t.between(x["start"], x["end"])))))
    return out.select(key, "timestamps", inside.alias("speech_count"), (F.size("timestamps") - inside).alias("non_speech_count"), F.when(quiet, F.lit(0.0)).otherwise(F.col("speech_len")).alias("speech_total_seconds"), F.col("silent_len").alias("non_speech_total_seconds"))
