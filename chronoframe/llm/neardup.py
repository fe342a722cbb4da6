"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the sequence of its five-word shingles. Repeated shingles are told apart by how often they have occurred before. Each of several
sketches takes the least few occurrence-labelled shingles under its own hash and keeps them in the order of the text, so that two
documents share a sketch only if the sampled shingles agree and stand in the same order. Documents that share a sketch are
aligned word by word within a band: they are near-duplicates if at most 0.2 of the longer one's words are edited.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import discard, give_back, materialize, read, text_of, with_text_id
from chronoframe.llm.edits import banded, distance, trimmed
from chronoframe.llm.linking import FAR, link, only

WORDS, SIMILARITY, SKETCHES, LEAST = 5, 0.8, 32, 2
#: Edited words up to which the band grows with the distance; beyond them whole columns are worked out in bits.
BAND = 40

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_SEEDS = np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x5851F42D4C957F2D
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_ODDS = _mix(_SEEDS) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            out = np.full(max(n, 1 << 16), base, np.uint64)
            out[0] = 1
            _POWERS[k] = np.multiply.accumulate(out)
    return _POWERS[0], _POWERS[1]


def word_hashes(text: str) -> np.ndarray:
    """One hash for every run of letters, digits, underscores and characters beyond ASCII, in lower case."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate([[False], _WORD[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str, w: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the runs of so many words of a text, in order. A shorter text is one shingle; one without words is a shingle of its characters."""
    if not len(w):
        return np.frombuffer(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), np.uint64)
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(w))):
        h = _mix(h * np.uint64(31) + w[k : k + n])
    return h


def sketches(h: np.ndarray, least: int = LEAST) -> np.ndarray:
    """One hash per sketch: the least occurrence-labelled shingles in the order of the text."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    runs = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    seen = np.empty(len(h), np.uint64)
    seen[order] = np.arange(len(h)) - np.repeat(runs, np.diff(np.append(runs, len(h))))
    values = _mix(h + seen * np.uint64(0xD6E8FEB86659FD93))[None, :] * _ODDS[:, None]
    k = min(least, len(h))
    chosen = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1) if k < len(h) else np.broadcast_to(np.arange(k), (len(_SEEDS), k))
    out = _SEEDS.copy()
    for c in range(k):
        out = _mix(out * np.uint64(31) + h[chosen[:, c]])
    return out.view(np.int64)


class Texts:
    """Texts as words, with a histogram of their hashes: what two have in common bounds their edits from below."""

    BINS = 1024

    def __init__(self, texts):
        self.words = self.sequences = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(h) for h in self.words], int)
        at = np.repeat(np.arange(len(texts)) * self.BINS, self.sizes)
        words = np.concatenate([*self.words, np.zeros(0, np.uint64)]) % np.uint64(self.BINS)
        self.bins = np.bincount(at + words.astype(int), minlength=len(texts) * self.BINS).reshape(-1, self.BINS).astype(np.int32)

    @staticmethod
    def near(size_x, size_y):
        return np.minimum(size_x, size_y) >= SIMILARITY * np.maximum(size_x, size_y) - 1e-9

    @staticmethod
    def near_columns(size_x, size_y):
        return F.least(size_x, size_y) >= F.lit(SIMILARITY) * F.greatest(size_x, size_y) - F.lit(1e-9)

    @staticmethod
    def allowed(size_x, size_y):
        """Texts without words are like no other one."""
        longer = np.maximum(size_x, size_y)
        return np.where(longer > 0, ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64), -1)

    def least(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        common = np.empty(len(xs), np.int64)
        for k in range(0, len(xs), 1024):
            common[k : k + 1024] = np.minimum(self.bins[xs[k : k + 1024]], self.bins[ys[k : k + 1024]]).sum(1)
        return np.maximum(self.sizes[xs], self.sizes[ys]) - common

    def measured(self, x: int, y: int) -> tuple[int, int]:
        allowed = int(self.allowed(self.sizes[x], self.sizes[y]))
        a, b = (w.tolist() for w in trimmed(self.words[x], self.words[y]))
        d = banded(a, b, min(allowed, BAND))
        if d is None:
            if allowed <= BAND:
                return allowed + 1, FAR
            d = distance(a, b)
        return d, d


def groups(docs: DataFrame) -> DataFrame:
    """docs: id, doc_id, text. Returns id, class_id, same_text, least, best: one row per different text.

    class_id is the least doc_id of the connected group, least that of the text, same_text its number of rows; best is true for one
    text of each group, the one with the least doc_id (nulls last). Texts are linked if alike(); null texts are empty.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in batch.column("text"):
                words = word_hashes(text := text.as_py())
                sizes.append(len(words))
                found.append(sketches(shingles(text, words)))
            starts = pa.array(np.arange(len(found) + 1, dtype=np.int32) * SKETCHES)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(starts, pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))], ["id", "size", "sketches"])
        give_back()

    sketched = materialize(docs.select("id", "text").mapInArrow(sketch, "id long, size int, sketches array<long>"), "sketches")
    members = sketched.select(F.explode("sketches").alias("key"), "id", "size")
    roots = link(members, lambda ids: only(docs, ids, "id").select("id", F.col("text").alias("value")).dropDuplicates(["id"]), Texts)
    # a text's rows are summed up before groups meet
    texts = docs.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("same_text"))
    texts = texts.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("unknown"), "least", "id")).alias("b"))
    out = texts.join(best, "root").select("id", F.col("b.least").alias("class_id"), "same_text", "least", (F.col("b.id") == F.col("id")).alias("best"))
    out = materialize(out, "classes")
    discard(sketched, roots)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, same_text: one row per row of docs."""
    d = with_text_id(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), "text", "id")
    return d.select("id", "doc_id").join(groups(d), "id").select("doc_id", "class_id", "same_text")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each group: the one with the least id, nulls last. Of rows that share id and text, one stays."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    d = with_text_id(rows, "text", "id")
    chosen = groups(d.drop("row")).where("best").select("id", F.col("least").alias("_least"))
    kept = d.join(chosen, "id").where(F.col("doc_id").eqNullSafe(F.col("_least")))
    return kept.dropDuplicates(["id"]).select("row.*")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


QUERIES = {"op9_neardup": op9_neardup}
