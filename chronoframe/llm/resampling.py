"""Importance resampling toward a target distribution of hashed word features.

Every run of one to three words is hashed into a bucket. Counts by bucket over the raw documents and over the target's texts give each
bucket a gain, the log of how much likelier the target is to use it. A document's weight is the sum of its features' gains, and
Gumbel noise by document makes the highest scores a sample without replacement in proportion to exp(weight / 1000).

Two passes read the documents, one to count and one to weigh; nothing but a row of five numbers per document is written or shuffled
besides the counts. Ranks come from a range-partitioned sort: a row's place in its partition plus the rows of the partitions before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.llm.common import discard, materialize, partitions, read, text_of
from chronoframe.llm.crc import crc32_of_spans

#: Buckets of features; words of a feature at most; words from which a document can be drawn; percent of these that are drawn.
BUCKETS, RUN, LEAST_WORDS, PERCENT = 10_000, 3, 20, 5
#: Bytes of text that are looked at together; a longer text is read in pieces of about this size.
PIECE = 1 << 18
#: A byte as it counts in a word (A-Z as a-z), 0 for those that part words.
_WORD = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _WORD[_b] = _b
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)


def features(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS, run: int = RUN, known: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of each feature, and the words of each text, for texts data[bounds[i] : bounds[i + 1]] of UTF-8 bytes.

    The first `known` words are those that an earlier piece ended with: features wholly among them are left out, and so are they from the words.
    """
    plain = _WORD[data]
    inside = plain != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    text = np.searchsorted(bounds, begins, side="right") - 1
    words = np.bincount(text[known:], minlength=len(bounds) - 1)
    length = ends - begins
    at = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int((length + 1).sum()), 0x20, np.uint8)  # the words, one space after each
    joined[np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)] = plain[inside]
    texts, found = [], []
    for n in range(1, run + 1):
        first = np.arange(max(0, known - n + 1), max(0, len(begins) - n + 1))
        first = first[text[first] == text[first + n - 1]]
        last = first + n - 1
        crc = crc32_of_spans(joined, at[first], at[last] + length[last] - at[first])
        texts.append(text[first])
        found.append((crc % np.uint32(buckets)).astype(np.int32))
    return np.concatenate(texts), np.concatenate(found), words


def pieces(data: np.ndarray, run: int = RUN, size: int = PIECE) -> Iterator[tuple[np.ndarray, int]]:
    """One long text in pieces cut between words, each after the last run - 1 words before it, with how many those are."""
    start, carried, known = 0, np.empty(0, np.uint8), 0
    while start < len(data):
        end = min(len(data), start + size)
        while end < len(data):  # a word longer than a piece stays whole
            gap = np.flatnonzero(_WORD[data[end : end + size]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(data), end + size)
        piece = np.concatenate([carried, data[start:end]])
        yield piece, known
        inside = np.concatenate([[False], _WORD[piece] != 0])
        begins = np.flatnonzero(inside[1:] & ~inside[:-1])[-(run - 1) :] if run > 1 else np.empty(0, int)
        known, start = len(begins), end
        carried = np.concatenate([piece[begins[0] :], np.array([0x20], np.uint8)]) if known else np.empty(0, np.uint8)


def slices(texts: pa.Array, buckets: int = BUCKETS, run: int = RUN, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, text, bucket, words) of groups of texts that hold about `size` bytes, or of a piece of a longer one."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, content = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1)
        own = data[bounds[first] : bounds[last]]
        if last == first + 1 and len(own) > 2 * size:
            for piece, known in pieces(own, run, size):
                yield first, 1, *features(piece, np.array([0, len(piece)]), buckets, run, known)
        else:
            yield first, last - first, *features(own, bounds[first : last + 1] - bounds[first], buckets, run)
        first = last


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """bucket, n: features of all texts by bucket. Each task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, bucket, _ in slices(batch.column(0), buckets, run):
                total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return texts.select(text_of(text_col).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the smoothed odds) by bucket; both counts have at most `buckets` entries."""
    s_all, t_all = float(sum(raw.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((raw.get(b, 0) + 1.0) * t_all))) for b in range(buckets)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", id_col: str = "doc_id", run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    kept = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, found, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, rows, text, bucket, n in slices(batch.column(1), len(gain), run):
                own = slice(first, first + rows)
                words[own] += n
                found[own] += np.bincount(text, minlength=rows)
                order = np.argsort(text, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                ends = np.cumsum(np.bincount(text, minlength=rows))
                weight[own] += np.diff(sums[np.concatenate([[0], ends])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(found), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return kept.mapInArrow(weigh, f"doc_id {dict(kept.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths by the id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of all rows; rank counts the drawn ones from 1 and is null for the others."""
    spark = scored.sparkSession
    can = F.when(F.col("n_words") >= least_words, F.col("score"))
    order = [can.desc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    dealt = scored.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # the upper bits of `at` are the partition, the lower 33 the place in it
    rows = materialize(dealt.withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))}), "resample-order")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= least_words).alias("able"))
    # one row per partition: sums over all of them, and over those before
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(F.sum("able").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    rank = F.col("before") + F.col("place") + 1
    return rows.join(F.broadcast(sizes), "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document, the drawn ones ranked by score, ties to the smaller id.

    Null and empty texts have no feature and weight 0. Rows that repeat an id get the same noise and are ranked one after the other. An empty
    table gives an empty result; an empty target leaves gains that favour rare buckets. Other columns are not read.
    """
    counts = [{r["bucket"]: r["n"] for r in bucket_counts(d, text_col, buckets).collect()} for d in (docs, target)]  # at most `buckets` rows each
    scored = weighed(docs, gains(*counts, buckets), text_col, id_col).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialize(scored, "resample-scores")  # the sort reads it twice
    out = ranked(scored, percent, least_words)
    discard(scored)
    return out


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH k AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), goal AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), df AS MATERIALIZED (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM docs
), gf AS MATERIALIZED (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM goal
), b AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f FROM df UNION SELECT f FROM gf), k
), s AS (SELECT bucket, count(*) AS n FROM df JOIN b USING (f) GROUP BY 1
), t AS (SELECT bucket, count(*) AS n FROM gf JOIN b USING (f) GROUP BY 1
), g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM gf) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)
), d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN b USING (f) JOIN g USING (bucket) GROUP BY 1
), a AS (
  SELECT docs.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(w) >= 20 AS able,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || docs.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN d USING (doc_id)
), r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * 5 // 100 THEN place END AS "rank" FROM r
"""

QUERIES = {"op13_resampling": op13_resampling}
SQL = {"op13_resampling": OP13_SQL}
