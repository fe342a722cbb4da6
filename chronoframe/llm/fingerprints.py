"""Document fingerprints by consistent weighted sampling.

For sample j, every term of a document gets r and c, Gamma(2,1) variables, and a uniform b, all read from a
hash of the term and j. With the term's weight w (its number of occurrences), t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1); the term with the least a, and its t, are the sample. Two documents agree in a sample with a
probability equal to sum(min(w, w')) / sum(max(w, w')), the generalised Jaccard similarity of their words.

All of it is DataFrame expressions. A sample is kept as one BIGINT, ln a in fixed point above 32 bits that name the
term and t, so that sampling is a minimum over the terms and aggregates in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.llm.common import partitions, read, text_of

SAMPLES = 40
LOW = (1 << 32) - 1
#: ln a lies within -192 and 64; 2^23 steps to a unit keep it under 31 bits.
SHIFT, STEPS = 192.0, float(1 << 23)


def _sample(term: Column, log_w: Column, j: int) -> Column:
    h = F.xxhash64(term, F.lit(j))
    g = F.xxhash64(h)
    uniform = lambda bits: bits + F.lit(0.5)
    r = -F.log(uniform(h.bitwiseAND(F.lit(LOW))) * uniform(F.shiftrightunsigned(h, 32)) * F.lit(2.0**-64))
    c = -F.log(uniform(g.bitwiseAND(F.lit((1 << 22) - 1))) * uniform(F.shiftrightunsigned(g, 42)) * F.lit(2.0**-44))
    b = uniform(F.shiftrightunsigned(g, 22).bitwiseAND(F.lit((1 << 20) - 1))) * F.lit(2.0**-20)
    t = F.floor(log_w / r + b)
    log_a = F.log(c) - r * (t - b + F.lit(1.0))
    rank = F.shiftleft(((log_a + F.lit(SHIFT)) * F.lit(STEPS)).cast("long"), 32)
    return rank.bitwiseOR(term.bitwiseXOR(t).bitwiseAND(F.lit(LOW)))


def _sampled(weighted: DataFrame, keys: list[str], weights: dict[str, str], n_samples: int) -> DataFrame:
    """weighted: keys, `term` BIGINT and counts, one row per term. Returns keys and, for each name -> count column in
    weights, the array of samples. No shuffle if weighted is already dealt out by some of the keys. What does not
    depend on the weight is computed once for all of them."""
    logs = weighted.select(*keys, "term", *[F.when(F.col(n) > 0, F.log(F.col(n).cast("double"))).alias(f"log_{n}") for n in weights.values()])
    least = [F.min(_sample(F.col("term"), F.col(f"log_{n}"), j)).alias(f"{name}{j}") for j in range(n_samples) for name, n in weights.items()]
    packed = logs.groupBy(*keys).agg(*least)
    return packed.select(*keys, *[F.array(*[F.col(f"{name}{j}").bitwiseAND(F.lit(LOW)) for j in range(n_samples)]).alias(name) for name in weights])


def words(text: Column) -> Column:
    """Lower-case words between white space; a text without words has the one term ''."""
    return F.split(F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     ")), " +")


def as_text(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples, an estimate of generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / F.size(a).cast("double")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint): the general form. Rows with the same id and text, and only those, are one; a null text is empty."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("key", F.xxhash64("text"))
    terms = d.select("doc_id", "key", F.explode(words(F.col("text"))).alias("word")).groupBy("doc_id", "key", F.xxhash64("word").alias("term")).agg(F.count("*").alias("n"))
    return _sampled(terms, ["doc_id", "key"], {"own": "n"}, n_samples).select("doc_id", as_text(F.col("own")).alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, rid, ghost, doc_id, text, next_text; the rows of a bucket are consecutive in ascending doc_id and lie in one partition.

    Buckets are cut at quantiles of the id, so no task sees all rows. A bucket's last document finds its successor, the
    first of the following bucket, as an extra row with ghost set; after the last document comes the first. Null ids come
    first; equal ids are ordered by text. Extra columns are left out, so none can clash.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    n = 4 * partitions(spark)
    row = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("at")).first()
    bounds = sorted(set(row["at"] or []))
    if bounds:
        at = F.array(*[F.lit(x) for x in bounds])
        bucket = F.coalesce(F.size(F.filter(at, lambda x: x <= F.col("doc_id"))), F.lit(0))
    else:
        bucket = F.lit(0)
    d = d.withColumn("bucket", bucket)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    first = d.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text")).alias("f"))
    all_buckets = Window.orderBy("bucket")
    ghosts = first.select(
        F.col("f.doc_id").alias("doc_id"),
        F.col("f.text").alias("text"),
        F.coalesce(F.lag("bucket").over(all_buckets), F.max("bucket").over(all_buckets.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("bucket"),
    )
    both = d.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True))).repartition(partitions(spark), "bucket")
    w = Window.partitionBy("bucket").orderBy("ghost", *order)
    return both.withColumn("rid", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per row of docs.

    The edited text is the text with its last floor(n_chars/4) code points replaced by the first as many of the next
    document's. The text is shuffled once, by bucket; terms, weights, samples and neighbours are all found within it.
    Null texts are empty; an empty table gives an empty result; a table of one row has itself as the next one.
    """
    d = with_next(docs, id_col, text_col)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.when(~F.col("ghost"), F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    body = d.select("bucket", "rid", F.posexplode(F.array("text", edited)).alias("which", "body")).where(F.col("body").isNotNull())
    terms = body.select("bucket", "rid", "which", F.explode(words(F.col("body"))).alias("word"))
    weighted = terms.groupBy("bucket", "rid", F.xxhash64("word").alias("term")).agg(F.count("*").alias("n"), F.sum("which").alias("n_edit"))
    weighted = weighted.withColumn("n_own", F.col("n") - F.col("n_edit"))
    sampled = _sampled(weighted, ["bucket", "rid"], {"own": "n_own", "edit": "n_edit"}, n_samples)
    following = F.lead("own").over(Window.partitionBy("bucket").orderBy("rid"))
    found = sampled.withColumn("following", following).select(
        "bucket",
        "rid",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edit")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
    facts = d.where(~F.col("ghost")).select("bucket", "rid", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"))
    return facts.join(found, ["bucket", "rid"]).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {"op1_fingerprints": op1_fingerprints}
