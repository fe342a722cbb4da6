"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks that overlap by a filter's width, so that every window of every document lies in a
chunk. Learned filters, one weight per place and byte value, slide over the chunks; a filter's largest
response in a chunk is that chunk's feature. The mean and the maximum of the chunk features over the document go through one
logistic unit. Filters and unit are trained together by gradient descent on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import give_back, read, text_of

WIDTH, FILTERS, CHUNK = 4, 16, 256
#: Training: at most so many labelled documents, chosen by a hash of the id.
TRAIN_DOCS, EPOCHS, BATCH = 3000, 14, 24
THRESHOLD = 0.3
#: Weight of a document with label 0 in the loss; offsets a threshold below one half.
REJECT_WEIGHT = 2.5
#: Chunks that are convolved at once; bounds the memory of a task for texts of any length.
AT_ONCE = 1024


class Model(NamedTuple):
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    intercept: float


def chunks_of(data: bytes, chunk: int = CHUNK, width: int = WIDTH) -> np.ndarray:
    """Rows of chunk + width - 1 bytes, each starting chunk bytes after the one before; the last is filled up with zeros."""
    n = max(1, -(-len(data) // chunk))
    padded = np.zeros(n * chunk + width - 1, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, chunk + width - 1)[::chunk]


def responses(chunks: np.ndarray, model: Model) -> np.ndarray:
    """chunks x places x filters."""
    width, places = model.tables.shape[0], chunks.shape[1] - model.tables.shape[0] + 1
    out = model.tables[0][chunks[:, :places]]
    for w in range(1, width):
        out += model.tables[w][chunks[:, w : w + places]]
    return out


def features(data: bytes, model: Model) -> np.ndarray:
    rows = chunks_of(data)
    total, most = np.zeros(len(model.bias)), np.zeros(len(model.bias))
    for at in range(0, len(rows), AT_ONCE):
        pooled = np.maximum(responses(rows[at : at + AT_ONCE], model).max(1) + model.bias, 0)
        total += pooled.sum(0)
        most = np.maximum(most, pooled.max(0))
    return np.concatenate([total / len(rows), most])


def score(data: bytes, model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(features(data, model) @ model.weights + model.intercept, -30, 30))))


def _batch_scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Scores of many texts; their chunks are convolved together, AT_ONCE at a time."""
    rows = [chunks_of(t) for t in texts]
    counts = np.array([len(r) for r in rows])
    pooled = np.concatenate([np.maximum(responses(block, model).max(1) + model.bias, 0) for block in _blocks(rows)])
    starts = np.cumsum(counts) - counts
    x = np.concatenate([np.add.reduceat(pooled, starts) / counts[:, None], np.maximum.reduceat(pooled, starts)], 1)
    return 1 / (1 + np.exp(-np.clip(x @ model.weights + model.intercept, -30, 30)))


def _blocks(rows: list[np.ndarray]) -> Iterator[np.ndarray]:
    held, n = [], 0
    for r in rows:
        for at in range(0, len(r), AT_ONCE):
            part = r[at : at + AT_ONCE]
            if n + len(part) > AT_ONCE and held:
                yield np.concatenate(held)
                held, n = [], 0
            held.append(part)
            n += len(part)
    if held:
        yield np.concatenate(held)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int | None = None, seed: int = 7) -> Model:
    """Adam on the log loss, EPOCHS times over the texts, or up to three times as often where these are few; a maximum passes its gradient to the place that reached it. No texts give an even score of 1/2."""
    epochs = epochs or int(np.clip(1000 * BATCH // max(1, len(texts)), EPOCHS, 3 * EPOCHS))
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, 2 * FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    rows = [chunks_of(t) for t in texts]
    for epoch in range(epochs if texts else 0):
        rate = 0.02 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.0005
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            block = np.concatenate([rows[d] for d in docs])
            counts = np.array([len(rows[d]) for d in docs])
            owner = np.repeat(np.arange(len(docs)), counts)
            starts = np.cumsum(counts) - counts
            model = Model(*params)
            best, where = np.empty((len(block), FILTERS), np.float32), np.empty((len(block), FILTERS), np.int64)
            for b in range(0, len(block), AT_ONCE):
                r = responses(block[b : b + AT_ONCE], model)
                where[b : b + AT_ONCE] = r.argmax(1)
                best[b : b + AT_ONCE] = np.take_along_axis(r, where[b : b + AT_ONCE][:, None, :], 1)[:, 0]
            pooled = np.maximum(best + params[1], 0)
            most = np.maximum.reduceat(pooled, starts)
            x = np.concatenate([np.add.reduceat(pooled, starts) / counts[:, None], most], 1)
            p = 1 / (1 + np.exp(-np.clip(x @ params[2] + params[3], -30, 30)))
            d = ((p - labels[docs]) * np.where(labels[docs] > 0, 1, REJECT_WEIGHT) / len(docs)).astype(np.float32)
            d_mean, d_most = d[:, None] * params[2][:FILTERS], d[:, None] * params[2][FILTERS:]
            d_pooled = (d_mean / counts[:, None])[owner] + d_most[owner] * (pooled == most[owner])
            d_best = d_pooled * (pooled > 0)
            g_tables = np.zeros_like(params[0])
            for w in range(WIDTH):
                byte = np.take_along_axis(block, where + w, 1)
                np.add.at(g_tables[w], (byte, np.arange(FILTERS)[None, :]), d_best)
            grads = [g_tables, d_best.sum(0), x.T @ d + 1e-4 * params[2], np.array([d.sum()], np.float32)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] = (params[k] - rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(params[0], params[1], params[2], float(params[3][0]))


def held_out(doc_id):
    """Documents that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS) -> Model:
    """Fit on at most `limit` labelled documents that are not held out. Null labels and ids are left out; texts are learnt from as a whole."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).where(F.col("_label").isNotNull() & ~held_out(F.col("_id")))
    drawn = known.orderBy(F.xxhash64("_id"), "_label").limit(limit)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(drawn), "_id")
    rows = sorted(((r["_id"], r["_text"], r["_label"]) for r in rows.orderBy(F.xxhash64("_id", "_text")).limit(limit).collect()))
    return fit([t.encode() for _, t, _ in rows], np.array([float(y) for _, _, y in rows], np.float32))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1. Columns are kept; one named score is replaced. Null texts count as empty."""
    kept = docs.drop("score")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            data = [(t or "").encode() for t in batch]
            yield pd.Series(_batch_scores(data, model) if data else [], dtype=float)
        give_back()

    score_of = F.pandas_udf(run, "double")
    return kept.withColumn("score", score_of(text_of(text_col)))


def kept_by_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= threshold).select(*docs.columns)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read(spark, sf_dir, "labels"))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op4_quality": op4_quality}
