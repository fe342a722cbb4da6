"""Approximate nearest neighbours: inverted file, product-quantised residuals, asymmetric distances, exact reranking.

Coarse centroids and the quantisers of the residuals are fitted on a bounded sample; every row is indexed. A query visits its
nearest cells, as many as held the neighbours of rows within the sample, and more where its own neighbours in the sample lie farther out. There, a table of distances from its
residual to every quantiser entry ranks the codes, and the best of them are ranked again by their exact distance; so are all others that the code's error, kept with it,
does not show to be farther. Spark deals index rows and queries out by cell; a cell with
many rows is dealt out as several shards, and its queries as several batches, so that each task holds bounded blocks of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.llm.common import read

#: Rows that the index is fitted on, chosen by hash of the id.
SAMPLE = 20_000
#: Sample rows per cell at least, so many cells at most; share of sample neighbours that visited cells hold; queries of the sample that tell it.
PER_CELL, HELD, TRIALS = 16, 0.96, 500
#: How many times k of the nearest rows of a sample that is thinner than the table tell a query's cells.
SAFE = 3
#: Quantisers; codes that are reranked in a shard at first; rows of a shard and queries of a batch, on average by hash.
QUANTISERS, RERANKED, SHARD, BATCH = 16, 100, 4096, 2048


class Index(NamedTuple):
    centroids: np.ndarray  # cells x dim
    entries: np.ndarray  # quantisers x entries x width, of residuals padded to quantisers * width
    visited: int  # cells that a query visits


def usable(vector: Column) -> Column:
    """Vectors that are null, empty, zero or hold null or non-finite components take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, points x centres; seen from amid the centres, as squares of what lies far off would swallow the differences."""
    amid = np.median(centres[:1000], axis=0)
    points, centres = points - amid, centres - amid
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[: min(k, len(distinct))]].copy()
    for _ in range(rounds):
        own = nearest(points, centres).argmin(1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x, len(centres)) for x in points.T], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def parts(residuals: np.ndarray, quantisers: int) -> np.ndarray:
    width = -(-residuals.shape[1] // quantisers)
    padded = np.zeros((len(residuals), quantisers * width))
    padded[:, : residuals.shape[1]] = residuals
    return padded.reshape(len(residuals), quantisers, width)


def cells_to_visit(sample: np.ndarray, centroids: np.ndarray, k: int, held: float = HELD, trials: int = TRIALS) -> int:
    """How many cells, nearest first, hold `held` of the k nearest rows of the sample for queries spread over it.

    The sample is thinner than the table, so its neighbours are farther and lie in more cells: what it tells is on the safe side.
    """
    cell = nearest(sample, centroids).argmin(1)
    asked = np.unique(np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int))
    if len(sample) <= k + 1:
        return len(centroids)
    ranks = []
    for part in np.array_split(asked, max(1, len(asked) // 50)):
        d = nearest(sample[part], sample)
        d[np.arange(len(part)), part] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        place = np.empty((len(part), len(centroids)), int)
        np.put_along_axis(place, np.argsort(nearest(sample[part], centroids), 1, kind="stable"), np.arange(len(centroids))[None], 1)
        ranks.append(np.take_along_axis(place, cell[near], 1).ravel())
    return int(np.quantile(np.concatenate(ranks), held, method="higher")) + 1


def cells_of_own(index: Index, sample: np.ndarray, cell: np.ndarray, queries: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """How many cells, in its order of cells, hold the k nearest rows of the sample for each query itself, whatever rows the sample's queries are.

    Where the sample is thinner than the table, a row of the table is farther out than the farthest of k sample rows about once in k + 1 cases: k is to be larger then. A query that is in the sample is among its k + 1 nearest and lies in a cell that is visited anyway.
    """
    most, out = min(k + 1, len(sample)), []
    for q, o in zip(np.array_split(queries, -(-len(queries) // 50)), np.array_split(order, -(-len(queries) // 50)), strict=True):
        near = np.argpartition(nearest(q, sample), most - 1, axis=1)[:, :most]
        place = np.empty(o.shape, int)
        np.put_along_axis(place, o, np.arange(o.shape[1])[None], 1)
        out.append(np.take_along_axis(place, cell[near], 1).max(1) + 1)
    return np.maximum(np.concatenate(out), index.visited)


def fit(sample: np.ndarray, cells: int, k: int = 10, quantisers: int = QUANTISERS, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    centroids = k_means(sample, cells, rng)
    residuals = parts(sample - centroids[nearest(sample, centroids).argmin(1)], quantisers)
    entries = [k_means(residuals[:, m], 256, rng, 6) for m in range(quantisers)]
    most = max(len(e) for e in entries)  # fewer distinct residuals: the last entry is repeated
    return Index(centroids, np.stack([np.concatenate([e, np.repeat(e[-1:], most - len(e), 0)]) for e in entries]), cells_to_visit(sample, centroids, k))


def encode(index: Index, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, codes, and how far each vector lies from what its code stands for."""
    cell = nearest(vectors, index.centroids).argmin(1)
    residuals = parts(vectors - index.centroids[cell], len(index.entries))
    codes = np.stack([nearest(residuals[:, m], index.entries[m]).argmin(1) for m in range(len(index.entries))], 1)
    error = np.sqrt(sum(((residuals[:, m] - index.entries[m][codes[:, m]]) ** 2).sum(1) for m in range(len(index.entries))))
    return cell, codes.astype(np.uint8), error


def search_shard(index: Index, rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of one shard for each of its queries, by exact distance: of RERANKED by asymmetric distance, and of all that may be as near by it as the k-th of these."""
    order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
    ids = rows["vec_id"].to_numpy()[order]
    codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)[order]
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)[order]
    error = rows["error"].to_numpy()[order]
    centre = index.centroids[int(rows["cell"].iloc[0])]
    out = []
    for query, vector in zip(queries["vec_id"], queries["vector"], strict=True):
        q = np.asarray(vector, np.float64)
        table = ((parts((q - centre)[None], len(index.entries))[0][:, None, :] - index.entries) ** 2).sum(2)
        rough = table[np.arange(len(table)), codes].sum(1)
        own = ids == query
        rough[own] = np.inf
        short = np.argsort(rough, kind="stable")[: RERANKED + int(own.sum())]
        short = short[~own[short]]
        exact = np.sqrt(((vectors[short] - q) ** 2).sum(1))
        if len(exact) >= k:
            limit, rough = np.partition(exact, k - 1)[k - 1], np.sqrt(rough)
            short = np.flatnonzero(~own & (rough - error <= limit + 1e-9 * (limit + np.where(own, 0, rough) + error)))
            exact = np.sqrt(((vectors[short] - q) ** 2).sum(1))
        best = np.lexsort((ids[short], exact))[:k]
        out.append(pd.DataFrame({"query_id": query, "vec_id": ids[short][best], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for every usable row for which `queries`, over vec_id, holds; all usable rows are candidates.

    Nearest first, ties to the smaller id; a row is never its own neighbour. Fewer than k candidates give fewer rows, an empty
    table none. Rows with a null id or with another dimension than most of the sample take no part. Rows that share an id are all
    candidates; the first of them by value is the query.
    """
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    schema = "query_id long, rank int, vec_id long, score double"
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["vector"]
    if sample.empty:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = int(sample.map(len).mode().iloc[0])
    n = v.count()
    v = v.where(F.size("vector") == dim)
    fitted = np.stack([np.asarray(x, np.float64) for x in sample if len(x) == dim])
    index = fit(fitted, max(1, min(round(n**0.5), len(fitted) // PER_CELL)), k)
    cells, cell_of = len(index.centroids), nearest(fitted, index.centroids).argmin(1)
    looked_at = k if n <= len(sample) else SAFE * k

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, codes, error = encode(index, np.stack(b["vector"].to_numpy()).astype(np.float64))
                yield b.assign(cell=cell, codes=[c.tobytes() for c in codes], error=error)

    kind = dict(v.dtypes)["vector"]
    placed = v.mapInPandas(place, f"vec_id long, vector {kind}, cell int, codes binary, error double")

    def by_cell(d: DataFrame) -> np.ndarray:
        out = np.zeros(cells, np.int64)
        for r in d.groupBy("cell").count().collect():  # a number per cell
            out[r["cell"]] = r["count"]
        return out

    counts = by_cell(placed)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                wanted = np.stack(b["vector"].to_numpy()).astype(np.float64)
                order = np.argsort(nearest(wanted, index.centroids), 1, kind="stable")
                visited = cells_of_own(index, fitted, cell_of, wanted, order, looked_at)[:, None]
                # more cells where the nearest ones hold too few rows
                before = np.cumsum(counts[order], 1) - counts[order]
                row, place = np.nonzero((np.arange(cells) < visited) | (before <= k))
                yield b.iloc[row].assign(cell=order[row, place])

    asked = v.where(queries).groupBy("vec_id").agg(F.min("vector").alias("vector")).mapInPandas(visit, f"vec_id long, vector {kind}, cell int")
    # how many shards a cell's rows are dealt out to, and how many batches its queries
    dealt = lambda n, size: np.maximum(1, -(-n // size)).tolist()
    shards, batches = dealt(counts, SHARD), dealt(by_cell(asked), BATCH)
    of = lambda numbers: F.get(F.array(*[F.lit(x) for x in numbers]), F.col("cell"))
    other = lambda numbers: F.explode(F.sequence(F.lit(0), of(numbers) - 1))
    own = lambda numbers: F.pmod(F.xxhash64("vec_id"), of(numbers)).cast("int")
    placed = placed.withColumn("shard", own(shards)).withColumn("batch", other(batches))
    asked = asked.withColumn("batch", own(batches)).withColumn("shard", other(shards))

    def find(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_shard(index, rows, wanted, k)

    found = placed.groupBy("cell", "shard", "batch").cogroup(asked.groupBy("cell", "shard", "batch")).applyInPandas(find, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op10_neighbours": op10_neighbours}
