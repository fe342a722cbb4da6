"""URL filter: rules by host and path, and a character language-model ratio for the URLs without a rule.

Two smoothed variable-order Markov models of characters, one of accepted and one of rejected URLs, are counted over all URLs that a
rule decides. An order's estimate leans on the next lower one: p_k = (n(context, char) + A p_(k-1)) / (n(context) + A). A URL's score is the
difference of its log-likelihoods, divided by its length. The score from which a URL is accepted is calibrated on URLs with
rules that neither model has counted.

Counts are exact: an n-gram of up to six bytes is a 64-bit number of its own, and the counts are a table that grows with the
input. A byte's share of the score depends on it and the five bytes before alone, so it is worked out once for every distinct
run of six bytes and joined to the URLs' runs, salted, since some runs are in every URL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize, read

ORDER, A = 5, 2.0
#: Parts into which the occurrences of a run of bytes are dealt.
SALTS = 16
#: Scores are calibrated in steps of 0.01 between -5 and 5.
STEP, LIMIT = 0.01, 5.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def runs(urls: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every URL: the run of ORDER + 1 bytes that ends with it, zeros before the URL, as a number; and the URL it is in."""
    lead = bytes(ORDER)
    data = np.frombuffer(b"".join([lead + u for u in urls]), np.uint8).astype(np.int64)
    sizes = np.array([len(u) for u in urls], np.int64)
    owner = np.repeat(np.arange(len(urls)), sizes)
    at = np.arange(sizes.sum()) + (owner + 1) * len(lead)
    run = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        run = run << 8 | data[at - k]
    return run, owner


def keys_of(run: Column) -> Column:
    """The run's n-grams of 1 to ORDER + 1 bytes, then their contexts of 0 to ORDER bytes; each number tells its length and kind."""
    grams = [run.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).bitwiseOR(F.lit(2 * k << 48)) for k in range(ORDER + 1)]
    contexts = [F.shiftright(run, 8).bitwiseAND(F.lit((1 << 8 * k) - 1)).bitwiseOR(F.lit((2 * k + 1) << 48)) for k in range(ORDER + 1)]
    return F.array(*grams, *contexts)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does. Of equally long ones, the longer host's."""
    found = [
        F.when(((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path)), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r))
    ]
    return F.coalesce(*found)


def ruled(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict (null where no rule fits)."""
    host, path = host_and_path(F.col("url"))
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    d = d.withColumn("host", host).withColumn("path", path)
    return d.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", "_rule.rule", "_rule.verdict")


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """row, run, n of row, url."""
    for batch in batches:
        run, owner = runs([u.encode("utf-8", "replace") for u in batch["url"]])
        found = pd.DataFrame({"row": batch["row"].to_numpy()[owner], "run": run})
        yield found.groupby(["row", "run"], as_index=False).size().rename(columns={"size": "n"})


def shares(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """run, share: ln p(accepted) - ln p(rejected) of the wanted runs' last bytes. counted: run, good, bad; wanted: run; both distinct."""
    counts = counted.select(F.explode(keys_of(F.col("run"))).alias("key"), "good", "bad").groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    asked = wanted.select("run", F.posexplode(keys_of(F.col("run"))).alias("k", "key"))
    # short keys are in most runs: what is joined is one row a key, and the runs of a key are dealt by salt; n-grams of five bytes and
    # contexts of four are in 65536 runs at most. Spark takes a table for as small as before explode, and would broadcast it
    last = F.when(F.shiftright("key", 48) < 8, F.lit(SALTS - 1)).otherwise(F.lit(0))
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    seen = asked.withColumn("salt", F.pmod(F.xxhash64("run"), last + 1).cast("int")).join(salted.hint("merge"), ["key", "salt"], "left")
    at = [(F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")) for k in range(2 * (ORDER + 1)) for c in ("good", "bad")]

    def log_p(c: str) -> Column:
        p = F.lit(1 / 256)
        for k in range(ORDER + 1):
            p = (F.col(f"{c}{k}") + A * p) / (F.col(f"{c}{k + ORDER + 1}") + A)
        return F.ln(p)

    return seen.groupBy("run").agg(*at).select("run", (log_p("good") - log_p("bad")).alias("share"))


def threshold_of(rows: Sequence) -> float:
    """The score from which URLs are accepted. rows: step, good, bad in order of step."""
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, lost, kept_out = (-1.0, 0.0), 0, 0
    for r in rows:
        fair = (good - lost) / good + kept_out / bad
        if (fair, -abs(r["step"] * STEP)) > (best[0], -abs(best[1])):
            best = (fair, r["step"] * STEP)
        lost, kept_out = lost + r["good"], kept_out + r["bad"]
    return best[1]


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row per row of pages. score is null where a rule decides.

    A null or empty URL without a rule has the score 0. Without both accepted and rejected URLs to learn from, scores do not
    tell anything apart and URLs without a rule are allowed. Extra columns are left out. A fifth of the URLs with rules, by hash of
    id and URL, only calibrates the threshold.
    """
    d = ruled(pages, rules, id_col, url_col)
    row, aside = F.xxhash64("url", F.lit(1)), F.pmod(F.xxhash64("page_id", "url"), F.lit(5)) == 0
    decided = F.col("rule").isNotNull()
    free = F.coalesce(F.col("url"), F.lit("")).alias("url")
    d = d.withColumn("counted", decided & ~aside & F.col("url").isNotNull())
    by_rule = d.where(decided).select("page_id", "host", "path", "rule", "verdict", F.lit(None).cast("double").alias("score"))
    taught = d.where("counted").groupBy("url").agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad"))
    taught = materialize(taught.withColumn("row", row), "url-taught")
    learnt = taught.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not (learnt["good"] and learnt["bad"]):
        return by_rule.unionByName(d.where(~decided).select("page_id", "host", "path", "rule", F.lit("allow").alias("verdict"), F.lit(0.0).alias("score")))
    said = lambda t: t.select("row", "url").mapInPandas(_runs, "row long, run long, n long")

    def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            run, owner = runs([u.encode("utf-8", "replace") for u in batch["url"]])
            found = pd.DataFrame({"run": run, "good": batch["good"].to_numpy()[owner], "bad": batch["bad"].to_numpy()[owner]})
            yield found.groupby("run", as_index=False).sum()

    counted = taught.select("url", "good", "bad").mapInPandas(weighed, "run long, good long, bad long").groupBy("run").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    counted = materialize(counted, "url-runs-taught")
    asked = d.where(~F.col("counted")).select(free).where("url <> ''").distinct().withColumn("row", row)
    asked = materialize(said(asked), "url-runs")
    share = shares(counted, asked.select("run").distinct())
    share = materialize(share, "url-shares").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = asked.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(share.hint("merge"), ["run", "salt"])
    scores = materialize(found.groupBy("row").agg((F.sum(F.col("share") * F.col("n")) / F.sum("n")).alias("score")), "url-scores")
    rest = d.where(~F.col("counted")).withColumn("row", F.xxhash64(free, F.lit(1))).join(scores, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    step = F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) / STEP).cast("int")
    known = rest.where(decided & F.col("url").isNotNull())
    threshold = threshold_of(known.groupBy(step.alias("step")).agg(F.count_if(F.col("verdict") == "allow").alias("good"), F.count_if(F.col("verdict") == "block").alias("bad")).orderBy("step").collect())
    verdict = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    by_model = rest.where(~decided).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
    return by_rule.unionByName(by_model)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(read(spark, sf_dir, "pages"))


QUERIES = {"op7_urls": op7_urls}
