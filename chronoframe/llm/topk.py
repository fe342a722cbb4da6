"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector is cut into slices of its components, and rows are dealt out in shards: a node is one slice of one shard and knows its rows'
partial scores only. A query's score is the sum of its partial scores over the slices.

1. Every node returns its few best partial scores for each query. What is gathered is summed exactly; the k-th best sum is the cutoff. Any row
   at or above it has at least one partial score of cutoff / slices or more.
2. The cutoff goes to all nodes, and each returns every entry that reaches this uniform share (and could reach the cutoff, were the rest of
   the two vectors parallel).
3. The partial scores that are still missing of the rows collected are asked for, and the sums are ranked.

Rows with equal vectors are searched as one class, which keeps the k + 1 smallest ids: no other can be among the k nearest. Queries with equal vectors
are one query as well. Nodes hold bounded blocks of rows and queries, so no task and no group grows with the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoframe.llm.common import discard, materialize, read

#: What a component is multiplied by, slices of a vector, rows of a shard and queries of a block (on average, by hash).
SCALE, SLICES, SHARD, BLOCK = 256, 2, 2048, 1024
#: Components are held within this, so that sums of up to 2,048 products fit a BIGINT.
MOST = 1 << 26
_NODE = ["dim", "shard", "block", "slice"]


def usable(vector: Column) -> Column:
    """Vectors that are null, empty or hold null or non-finite components take no part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as double, held within MOST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a with those of b, exact: in doubles while all sums are below 2^53, else in integers."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_parts(rows: pd.DataFrame, queries: pd.DataFrame, n: int) -> pd.DataFrame:
    """query, row, dim of the n best partial scores of each query at a node."""
    part = products(_stacked(queries["part"]), _stacked(rows["part"]))
    n = min(n, part.shape[1])
    top = np.argpartition(-part, n - 1, axis=1)[:, :n]
    return pd.DataFrame({"query": np.repeat(queries["query"].to_numpy(), n), "row": rows["row"].to_numpy()[top.ravel()], "dim": rows["dim"].iloc[0]})


def sufficient_parts(rows: pd.DataFrame, queries: pd.DataFrame, slices: int) -> pd.DataFrame:
    """query, row, dim, slice, part of all partial scores that reach the uniform share of their query's cutoff.

    A row whose partial scores are all below the share has a smaller sum than the cutoff. If all equal it, the sum ties and the smaller id
    wins. A partial score is left out as well if it cannot reach the cutoff with the largest inner product that the other slices' lengths allow.
    """
    part = products(_stacked(queries["part"]), _stacked(rows["part"]))
    cutoff, ids = queries["cutoff"].to_numpy(np.int64)[:, None], rows["row"].to_numpy()
    enough = (part * slices > cutoff) | ((part * slices == cutoff) & (ids[None, :] <= queries["cutoff_row"].to_numpy(np.int64)[:, None]))
    most = np.outer(queries["rest"].to_numpy(), rows["rest"].to_numpy()) * (1 + 1e-9) + 1
    q, r = np.nonzero(enough & (part + most >= cutoff))
    return pd.DataFrame({"query": queries["query"].to_numpy()[q], "row": ids[r], "dim": rows["dim"].iloc[0], "slice": rows["slice"].iloc[0], "part": part[q, r]})


def asked_parts(rows: pd.DataFrame, queries: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """query, row, part of the pairs that a node is asked for."""
    at = lambda known, wanted: np.searchsorted(known, wanted)
    r, q = rows.sort_values("row"), queries.sort_values("query")
    a, b = _stacked(q["part"]), _stacked(r["part"])
    i, j = at(q["query"].to_numpy(), pairs["query"].to_numpy()), at(r["row"].to_numpy(), pairs["row"].to_numpy())
    out = np.empty(len(pairs), np.int64)
    for k in range(0, len(pairs), 65_536):
        s = slice(k, k + 65_536)
        out[s] = np.einsum("ij,ij->i", a[i[s]], b[j[s]])
    return pd.DataFrame({"query": pairs["query"].to_numpy(), "row": pairs["row"].to_numpy(), "part": out})


class _Nodes:
    """Rows and queries as blocks of slices; `visit` brings each block of queries to each node."""

    def __init__(self, classes: DataFrame, queries: DataFrame, slices: int, shard: int, block: int):
        self.slices = slices
        # counts of two tables that are written
        self.shards, self.blocks = (max(1, -(-d.count() // size)) for d, size in ((classes, shard), (queries, block)))
        self.rows = self._sliced(classes, "row").withColumn("shard", self.shard_of("row")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        self.queries = queries

    def shard_of(self, row: str) -> Column:
        return F.pmod(F.xxhash64(row), F.lit(self.shards)).cast("int")

    def block_of(self, query: str) -> Column:
        return F.pmod(F.xxhash64(query), F.lit(self.blocks)).cast("int")

    def _sliced(self, d: DataFrame, name: str, *more: str) -> DataFrame:
        """A row per slice: its components, and the length of the rest of the vector."""
        width = F.ceil(F.size("v") / self.slices).cast("int")
        d = d.select(name, "v", F.size("v").alias("dim"), *more, width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))).alias("slice"))
        d = d.withColumn("part", F.slice("v", F.col("slice") * F.col("width") + 1, F.col("width")))
        norm = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        return d.select("dim", "slice", name, F.when(F.size("part") > 0, F.col("part")).otherwise(F.array(F.lit(0))).alias("part"), F.sqrt(F.greatest(norm("v") - norm("part"), F.lit(0.0))).alias("rest"), *more)

    def visit(self, find, schema: str, cutoffs: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """find(rows, queries, pairs) at every node for every block of queries. pairs: query, row, dim, slice."""
        none = lambda kind: F.lit(None).cast(kind)
        q, more = self.queries, ()
        if cutoffs is not None:
            q, more = q.join(cutoffs, "query"), ("cutoff", "cutoff_row")
        q = self._sliced(q, "query", *more).withColumn("block", self.block_of("query")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        left = self.rows.withColumn("query", none("long"))
        if pairs is not None:
            asked = pairs.select("dim", "slice", "row", none("array<int>").alias("part"), none("double").alias("rest"), self.shard_of("row").alias("shard"), self.block_of("query").alias("block"), "query")
            left = left.unionByName(asked)
        columns, asks = [x.split()[0] for x in schema.split(", ")], pairs is not None

        def at_node(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            wanted = rows["query"].notna()
            own = rows[~wanted]
            if own.empty or queries.empty or (asks and not wanted.any()):
                return pd.DataFrame({c: [] for c in columns})
            return find(own, queries, rows[wanted].astype({"query": "int64"}))

        return left.groupBy(*_NODE).cogroup(q.groupBy(*_NODE)).applyInPandas(at_node, schema)


def _best(totals: DataFrame, n: int) -> DataFrame:
    """Each query's n best rows: by score, then the smaller id."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "row"))
    return totals.withColumn("place", place).where(F.col("place") <= n)


def search(vectors: DataFrame, queries: Column, k: int = 5, scale: int = SCALE, slices: int = SLICES, shard: int = SHARD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product for every row for which `queries`, over vec_id, holds.

    All usable rows of the query's dimension but its own are candidates; ties go to the smaller id; fewer than k candidates give fewer rows. Null ids take no
    part; an id that occurs more than once counts with its least vector. Zero vectors count. Components of 262,144 and more count as that (at scale 256). Empty
    tables give empty results. A query that has many equal scores at its cutoff collects those with smaller ids only.
    """
    n = k + 1  # a query's own row may be among them
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    v = materialize(v.select("vec_id", integers(F.col("vector"), scale).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-vectors")
    # the limit per class is applied before the shuffle too, so copies of one vector do not meet in a task
    first = v.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= n)
    classes = materialize(first.groupBy("v").agg(F.min("vec_id").alias("row"), F.collect_list("vec_id").alias("ids")), "topk-classes")
    members = v.where(queries).select(F.col("vec_id").alias("query_id"), "v")
    asked = materialize(members.groupBy("v").agg(F.min("query_id").alias("query")), "topk-queries")
    nodes, pair = _Nodes(classes, asked, slices, shard, block), ["query", "row"]
    every = F.sequence(F.lit(0), F.lit(slices - 1))

    def totals(known: DataFrame | None, wanted: DataFrame) -> DataFrame:
        parts = nodes.visit(asked_parts, "query long, row long, part long", pairs=wanted)
        parts = parts if known is None else parts.unionByName(known)
        return parts.groupBy(*pair).agg(F.sum("part").alias("score"))

    listed = nodes.visit(lambda r, q, _: best_parts(r, q, n), "query long, row long, dim int").distinct()
    found = totals(None, listed.withColumn("slice", F.explode(every)))
    kth = _best(found, n).groupBy("query").agg(F.count("*").alias("n"), F.max_by(F.struct("score", "row"), "place").alias("last"))
    least = F.lit(-(1 << 62)).cast("long")  # fewer candidates than wanted: all of them are needed
    whole = F.col("n") == n
    cutoffs = materialize(kth.select("query", F.when(whole, F.col("last.score")).otherwise(least).alias("cutoff"), F.when(whole, F.col("last.row")).otherwise(F.lit((1 << 63) - 1)).alias("cutoff_row")), "topk-cutoffs")
    entries = materialize(nodes.visit(lambda r, q, _: sufficient_parts(r, q, slices), "query long, row long, dim int, slice int, part long", cutoffs=cutoffs), "topk-entries")
    missing = entries.groupBy(*pair, "dim").agg(F.collect_set("slice").alias("known")).select(*pair, "dim", F.explode(F.array_except(every, "known")).alias("slice"))
    best = _best(totals(entries.select(*pair, "part"), missing), n)
    # at most n rows with at most n ids each
    near = best.join(classes.select("row", "ids"), "row").select("query", "score", F.explode("ids").alias("vec_id"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id")))
    tops = near.groupBy("query").agg(F.slice(order, 1, n).alias("top")).join(asked, "query").select("v", "top")
    # one vector may be that of many queries: the join is one that Spark splits at run time
    each = members.join(tops, "v").select("query_id", F.posexplode(F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("at", "x"))
    out = materialize(each.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score")), "topk-result")
    discard(v, classes, asked, cutoffs, entries)
    return out


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id AND len(q.v) = len(r.v)),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM t WHERE "rank" <= 5
"""

QUERIES = {"op12_topk": op12_topk}
SQL = {"op12_topk": OP12_SQL}
