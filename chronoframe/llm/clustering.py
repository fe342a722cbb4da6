"""Centroid clustering of integer vectors with a LAESA pivot table.

A few pivots are fixed before the first round. Every vector's distance to each of them is computed once and kept in a table beside the
vector. In each round the distances of the centroids to the pivots are known, and |d(v, p) - d(c, p)| is at most d(v, c) for every pivot p: a
centroid whose largest such difference exceeds the distance to a centroid already measured cannot be nearer. Only the others get
exact integer distances. A round is one pass over the table; what comes back is a sum and a count per centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import discard, materialize, read

#: Components of a vector, what a component is multiplied by, centroids, rounds, the prefix of what chooses the first centroids.
DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, "3"
#: Pivots, and the vectors among which they are sought, chosen by hash of the id.
PIVOTS, CANDIDATES = 16, 1024
#: Components are held within this, so that every squared distance of 64 components fits a BIGINT.
MOST = 1 << 27


def kept(vector: Column, dim: int = DIM) -> Column:
    """Vectors with exactly `dim` components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double, held within MOST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def matrix(column: pa.Array, kind: type = np.int64) -> np.ndarray:
    """The rows of an array column of equal lengths; there is at least one."""
    return column.flatten().to_numpy().reshape(len(column), -1).astype(kind)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to those of b."""
    out = np.empty((len(a), len(b)), np.int64)
    for k, x in enumerate(b):
        gap = a - x
        out[:, k] = np.einsum("ij,ij->i", gap, gap)
    return out


def choose_pivots(points: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Points far from each other: each next one has the largest sum of distances to those before; none twice."""
    points = np.unique(points, axis=0)
    chosen, total = [0], np.zeros(len(points))
    while len(chosen) < min(n, len(points)):
        total += np.sqrt(squared(points, points[chosen[-1:]])[:, 0].astype(np.float64))
        total[chosen] = -1
        chosen.append(int(total.argmax()))
    return points[chosen]


def assigned(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, its squared distance, exact distances computed) for each vector; ties to the smaller number.

    table: the vectors' distances to the pivots. The centroid with the least bound is measured first; then, in order of their
    numbers, those whose bound does not exceed the best distance so far. Bounds are lowered by more than rounding can raise them.
    """
    to_pivots = np.sqrt(squared(centroids, pivots).astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for k in range(len(pivots)):
        here, there = table[:, k, None], to_pivots[None, :, k]
        np.maximum(bound, np.abs(here - there) - 1e-9 * (here + there) - 1e-6, out=bound)
    rows = np.arange(len(vectors))
    best = bound.argmin(1)
    gap = vectors - centroids[best]
    distance = np.einsum("ij,ij->i", gap, gap)
    first, computed = best.copy(), len(vectors)
    for c in range(len(centroids)):
        open_ = rows[(first != c) & (bound[:, c] <= np.sqrt(distance.astype(np.float64)))]
        gap = vectors[open_] - centroids[c]
        d = np.einsum("ij,ij->i", gap, gap)
        nearer = (d < distance[open_]) | ((d == distance[open_]) & (c < best[open_]))
        best[open_[nearer]], distance[open_[nearer]] = c, d[nearer]
        computed += len(open_)
    return best, distance, computed


def _round(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means; those without a vector stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0))
                own, _, _ = assigned(v, matrix(batch.column(1), np.float64), centroids, pivots)
                for c in range(len(centroids)):
                    total[c] += v[own == c].sum(0)  # of one batch: within 64 bits
                n += np.bincount(own, minlength=len(centroids))
        if n.any():
            c, k = np.indices(centroids.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array([str(x) for x in total.ravel()]), pa.array(np.repeat(n, centroids.shape[1]))], ["c", "k", "total", "n"])

    sent = table.select("v", "p").mapInArrow(sums, "c int, k int, total string, n long")
    out = centroids.copy()
    # one row per centroid and component, whatever the input's size
    for r in sent.groupBy("c", "k").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        if r["n"]:
            out[r["c"], r["k"]] = int(r["total"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, n_pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    The first centroids are the k vectors with the least SHA-256 of `seed:id`, fewer if there are fewer vectors; equal ones stay as they
    are, and all but the first of them get no vector. Rows that repeat an id are vectors of their own; a null id counts as an empty one. An
    empty table gives an empty result. Sums beyond a BIGINT are null. Components of 131,072 and more count as that (at scale 1024). Other columns are not read.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(kept(F.col("vector"), dim))
    v = v.select("vec_id", integers(F.col("vector"), scale).alias("v"))
    hashed = v.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    sample = hashed.orderBy("h", "vec_id", "v").limit(max(CANDIDATES, k)).collect()  # a bounded number of short rows
    points = np.array([r["v"] for r in sample], np.int64).reshape(len(sample), dim)
    centroids, pivots = points[:k].copy(), choose_pivots(points, n_pivots) if len(points) else points

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = np.sqrt(squared(matrix(batch.column(1)), pivots).astype(np.float64))
                offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))], ["vec_id", "v", "p"])

    id_kind = dict(v.dtypes)["vec_id"]
    table = materialize(v.mapInArrow(measured, f"vec_id {id_kind}, v array<int>, p array<double>"), "pivot-table")
    for _ in range(rounds if len(centroids) else 0):
        moved = _round(table, centroids, pivots)
        if (moved == centroids).all():
            break  # nothing moves any more
        centroids = moved

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, d, _ = assigned(matrix(batch.column(1)), matrix(batch.column(2), np.float64), centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    placed = materialize(table.mapInArrow(place, f"vec_id {id_kind}, cluster int, distance long"), "clusters")
    discard(table)
    own = {r["cluster"]: int(r["own"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()}  # a row per centroid
    fits = lambda x: x if x < 1 << 63 else None
    names = [(c, fits(own[c]), fits(sum(own.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist()) if c in own]
    sums = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds one after another, each a table of centroids made of the one before."""
    near = "SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, list_sum(list_transform(range(1, 65), lambda i: (v[i] - x[i]) * (v[i] - x[i])))::BIGINT AS d FROM q, {0}) GROUP BY vec_id, v"
    parts = [
        "q AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, v AS x FROM q ORDER BY c LIMIT {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(f'c{r}')})")
        parts.append(f"u{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)")
        parts.append(f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM u{r} GROUP BY c)")
        parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.x, c{r}.x) AS x FROM c{r} LEFT JOIN m{r} USING (c))")
    parts.append(f"p AS MATERIALIZED ({near.format(f'c{rounds}')})")
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256 FROM p JOIN c{rounds} USING (c)"


QUERIES = {"op11_clustering": op11_clustering}
SQL = {"op11_clustering": _sql()}
