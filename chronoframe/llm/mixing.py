"""Mixing sources to target weights with hash-threshold histograms.

Every source gets a target number of words. A source whose target exceeds its size is repeated: all its documents floor(target / size)
times, and for the rest of the target those documents once more whose hash is below a threshold. The threshold is found
without sorting: words are summed by source and hash bucket, the bucket in which the running sum passes the rest is
found, and only that bucket is split again by the next bits of the hash, until the hash has no more bits. The
documents below the threshold are then a filter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.llm.common import materialize, read, text_of

#: Bits of the hash that one histogram resolves, and how many histograms are nested.
BITS, LEVELS = 12, 4
#: Sources up to this many are joined by broadcast: a row of at most a few hundred bytes each.
BROADCAST_SOURCES = 50_000


def words_of(text: Column) -> Column:
    """Runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(docs_id: Column, text: Column) -> Column:
    """48 bits of the MD5 of id and text."""
    digest = F.md5(F.encode(F.concat(F.coalesce(docs_id.cast("string"), F.lit("")), F.lit("\x1f"), text), "UTF-8"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and hash; null texts have size 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words_of(text_of(text_col)).alias("size"), hash_of(F.col(id_col), text_of(text_col)).alias("hash"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target, full (whole repeats) and rest (words still to take), one row per source.

    Targets share `share` times all words by weight; a target stops at `most` times its source's size and what is over goes to
    the others by weight: target = min(most * size, level * weight) with the level that spends the budget. The
    level follows from running sums over the sources in the order in which they reach their stop. All windows here
    run over one row per source, never over documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("weight", w).withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    by = by.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    # the level if this source and all that stop before it are at their stop
    spent, stopped = F.sum("stop").over(filled), F.sum("weight").over(filled)
    by = by.withColumn("spent", spent).withColumn("open", F.col("all_weight") - stopped)
    before = F.col("spent") - F.col("stop")
    by = by.withColumn("level", (F.col("budget") - before) / (F.col("open") + F.col("weight")))
    # the first source, in this order, whose stop lies above the level sets the level of all that follow
    open_level = F.when(F.col("level") * F.col("weight") < F.col("stop"), F.col("level"))
    by = by.withColumn("final", F.first(open_level, ignorenulls=True).over(Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    by = by.withColumn("target", F.least(F.col("stop"), F.coalesce(F.col("final") * F.col("weight"), F.col("stop"))))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return by.select("source", "source_size", "target", full.alias("full")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))


def _with_sources(rows: DataFrame, by_source: DataFrame, few: bool) -> DataFrame:
    right = by_source.withColumnRenamed("source", "_source")
    return rows.join(F.broadcast(right) if few else right, rows["source"].eqNullSafe(right["_source"]), "inner").drop("_source")


def thresholds(sizes: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """goals with `below`: documents with a smaller hash make up the rest of the target, to within half of one hash value's words."""
    found = goals.select("source", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("taken"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = _with_sources(sizes, found, few)
        step = F.shiftright(F.col("hash"), shift)
        if level:
            inside = inside.where(F.shiftright(F.col("hash"), shift + BITS) == F.shiftright(F.col("below"), shift + BITS))
        histogram = inside.groupBy("source", step.alias("bucket")).agg(F.sum("size").alias("words"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        h = _with_sources(histogram.withColumn("running", running), found, few)
        # what fits wholly is taken; the first bucket that does not fit is split at the next level
        fits = F.col("taken") + F.col("running") <= F.col("rest")
        edge = h.groupBy("source").agg(F.max(F.when(fits, F.col("running"))).alias("more"), F.min(F.when(~fits, F.struct(F.col("bucket").alias("edge"), F.col("running").alias("past")))).alias("over")).select("source", "more", "over.*")
        edge = edge.withColumnRenamed("source", "_s")
        joined = found.join(F.broadcast(edge) if few else edge, found["source"].eqNullSafe(edge["_s"]), "left")
        # a source whose every bucket fits is taken up to the end of the range that is being split
        end = F.col("below") + F.shiftleft(F.lit(1).cast("long"), shift + BITS)
        now = F.col("taken") + F.coalesce(F.col("more"), F.lit(0))
        # of the last bucket, which no bit can split, what comes nearer to the target: with it or without
        nearer = F.lit(level == LEVELS - 1) & (F.col("taken") + F.col("past") - F.col("rest") < F.col("rest") - now)
        below = F.when(F.col("edge").isNull(), end).otherwise(F.shiftleft(F.col("edge"), shift) + nearer.cast("long"))
        found = joined.select("source", "rest", below.alias("below"), now.alias("taken"))
        found = materialize(found, "mix-edges")
    return found.select("source", "below")


def plan(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, bool]:
    """source, source_size, target, full, below, one row per source; and whether these are few enough to broadcast."""
    goals = materialize(targets(sizes, weights, share, most), "mix-targets")
    few = goals.count() <= BROADCAST_SOURCES
    limits = thresholds(sizes, goals, few).withColumnRenamed("source", "_s")
    return goals.join(limits, goals["source"].eqNullSafe(limits["_s"])).select("source", "source_size", "target", "full", "below"), few


def _copies(hash_: Column) -> Column:
    return F.when(F.col("source_size") > 0, F.col("full") + F.when(hash_ < F.col("below"), F.lit(1)).otherwise(F.lit(0))).otherwise(F.lit(0)).cast("int")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document.

    Sources in code point order, null last, take the weights in turn. copies is how often the mix has the document, taken its
    words times copies. A source's taken words differ from its target by at most half the words that share one 48-bit hash, which
    is one document unless rows repeat id and text. Empty tables give empty results; sources without words take nothing.
    """
    sizes = materialize(sized(docs, text_col, id_col, source_col), "mix-sizes")
    by_source, few = plan(sizes, weights, share, most)
    out = _with_sources(sizes, by_source, few).withColumn("copies", _copies(F.col("hash")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, columns as they were."""
    sizes = materialize(sized(docs, text_col, id_col, source_col), "mix-sizes")
    by_source, few = plan(sizes, weights, share, most)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).alias("source"), hash_of(F.col(id_col), text_of(text_col)).alias("hash"))
    taken = _with_sources(rows, by_source, few).select("row", F.array_repeat(F.lit(0), _copies(F.col("hash"))).alias("times"))
    return taken.select("row", F.explode("times")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, ''), chr(31), coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, 1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE AS budget FROM s
), l AS (
  SELECT *, (budget - (sum(stop) OVER w - stop)) / ((SELECT sum(weight) FROM s) - sum(weight) OVER w + weight) AS level
  FROM o WINDOW w AS (ORDER BY stop / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), f AS (
  SELECT *, (SELECT arg_min(level, struct_pack(a := stop / weight, b := coalesce(source, chr(1114111)))) FROM l WHERE level * weight < stop) AS final FROM l
), t AS (
  SELECT source, source_size, least(stop, coalesce(final * weight, stop)) AS target FROM f
), g AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, size * (CASE WHEN source_size > 0 THEN whole + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END ELSE 0 END) AS taken FROM c
"""

QUERIES = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": OP2_SQL}
