"""Links between members of buckets, verified, and the connected groups that they make.

A member of a bucket is first compared with the bucket's least member, its hub: as many pairs as members. What these links leave
apart is compared in full, but in tasks of bounded size: only members that are not yet connected meet, chunk by chunk, and a task
skips pairs that its earlier links already connect. So no link between different groups is lost, no bucket is limited, and
no bucket's pairs are ever written out. Of buckets with the same members only one is compared.

Rows of buckets are narrow (key, id, size); values are fetched for those members only whose pairs the sizes allow. The
measure is a metric: two members whose distances from their hub differ by more than two like members may be apart are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import discard, give_back, materialize
from chronoframe.llm.edits import distances

#: Members of a bucket that a task compares at once, twice; pairs tested at once; ids up to this many are broadcast (8 bytes each) to filter a table.
CHUNK, PAIRS, BROADCAST_IDS = 512, 8192, 1_000_000
#: A distance that none exceeds.
FAR = 1 << 30
TASK = ["key", "i", "j", "id", "root", "rest", "chunk", "size", "low", "high"]


class Values(Protocol):
    """Values between which a metric of whole numbers is measured, prepared once each. What it keeps must be small next to the values.

    Where the metric is the edit distance of sequences of numbers, `sequences` may hold these: then pairs are measured many at once, where there
    are `worth` of them for each block of 64 numbers (0, if there is no such attribute). `at_most(x, y)`, where there is one, is tried on each pair
    before: a distance that two values have at most, if it is soon found and allowed, else None.
    """

    def __init__(self, values: Sequence[str]): ...

    @staticmethod
    def near(size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
        """For pairs of members, whether their sizes allow that they are the same."""

    @staticmethod
    def near_columns(size_x: Column, size_y: Column) -> Column:
        """The same of columns."""

    @staticmethod
    def allowed(size_x: np.ndarray, size_y: np.ndarray) -> np.ndarray:
        """The distance up to which two values of these sizes are the same."""

    def least(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """For pairs of positions, a distance that they have at least: a quick bound."""

    def measured(self, x: int, y: int) -> tuple[int, int]:
        """Bounds of a distance from below and above; the upper one is within what is allowed if the distance is."""


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns id, root: every node that has an edge to another, with the least node of its connected group.

    Every round hooks each node to its least neighbour, shortcuts twice, and contracts the edges; the number of rounds
    grows with the logarithm of a group's size.
    """
    edges = materialize(edges.where("a != b").distinct(), "links")
    found = materialize(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("root", F.col("id")), "roots")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")).withColumnRenamed("a", "n"), "parents")
        up = hooked
        for _ in range(2):
            over = up.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            up = up.join(over, "p", "left").select("n", F.coalesce("pp", "p").alias("p"))
        up = materialize(up, "parents")
        before = found, edges, hooked, up
        found = materialize(found.join(up, found["root"] == up["n"], "left").select("id", F.coalesce("p", "root").alias("root")), "roots")
        left, right = up.select(F.col("n").alias("a"), F.col("p").alias("x")), up.select(F.col("n").alias("b"), F.col("p").alias("y"))
        edges = materialize(edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a != b").distinct(), "links")
        discard(*before)
    discard(edges)
    return found


def only(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose column is among the ids (one column, distinct): by broadcast if these are few, else by a shuffled join."""
    ids = ids.toDF("_only")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, rows[column] == ids["_only"], "left_semi")


def _bounds(values: Values, xs: np.ndarray, ys: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the distances of pairs of positions, from below and above: the distances themselves where many are measured at once.
    With `allowed` only the upper one holds, and is within what is allowed if the distance is."""
    sequences, at_most = getattr(values, "sequences", None), getattr(values, "at_most", None)
    low, high = np.full(len(xs), -1), np.full(len(xs), -1)
    if at_most is not None:
        for k, (x, y) in enumerate(zip(xs.tolist(), ys.tolist(), strict=True)):
            if (most := at_most(x, y)) is not None:
                low[k], high[k] = 0, most
    rest = np.flatnonzero(low < 0)
    if sequences is not None and len(rest):
        low[rest] = high[rest] = distances(sequences, xs[rest], ys[rest], None if allowed is None else allowed[rest], getattr(values, "worth", 0))
    for k in np.flatnonzero(low < 0).tolist():
        low[k], high[k] = values.measured(int(xs[k]), int(ys[k]))
    return low, high


def _verified(values_of: type[Values]):
    """Of rows a, b, size, hub_size, x, y the bounds of the distance from x to y, and whether it links a and b."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PAIRS // 8):
                part = batch.iloc[at : at + PAIRS // 8]
                codes, texts = pd.factorize(pd.concat([part["x"], part["y"]]))
                values, n = values_of(list(texts)), len(part)
                low, high = values.least(codes[:n], codes[n:]), np.full(n, FAR)
                allowed = values_of.allowed(part["size"].to_numpy(), part["hub_size"].to_numpy())
                k = np.flatnonzero(low <= allowed)
                low[k], high[k] = _bounds(values, codes[k], codes[n + k])
                yield pd.DataFrame({"a": part["a"], "b": part["b"], "low": low, "high": high, "linked": high <= allowed})
        give_back()

    return verify


def _alone(values_of: type[Values]):
    """Of the members of tasks (key, i, j) that lie together those with a partner that sizes and distances from the hub allow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, starts in _grouped(batches):
            found = np.zeros(len(group), bool)
            for xs, ys in _meeting(values_of, group, starts):
                found[xs] = found[ys] = True
            yield group.loc[found]

    return run


def _meeting(values_of: type[Values], group: pd.DataFrame, starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of each task's members that may be the same: the rest with the largest group, or with itself within
    a chunk or across two."""
    roots, rest, chunk = pd.factorize(group["root"])[0], group["rest"].to_numpy(), group["chunk"].to_numpy()
    sizes, low, high = (group[c].to_numpy() for c in ("size", "low", "high"))
    largest, across = (group["j"] < 0).to_numpy(), (group["i"] != group["j"]).to_numpy()
    for begin, end in zip(starts, [*starts[1:], len(group)], strict=True):
        at = np.arange(begin, end)
        own, step = at[rest[begin:end]], max(1, PAIRS // len(at))
        for k in range(0, len(own), step):
            xs, ys = np.repeat(own[k : k + step], len(at)), np.tile(at, len(own[k : k + step]))
            met = (roots[xs] != roots[ys]) & (~rest[ys] if largest[begin] else (ys > xs) & ((chunk[xs] != chunk[ys]) if across[begin] else rest[ys]))
            xs, ys = xs[met], ys[met]
            met = values_of.near(sizes[xs], sizes[ys])
            met &= np.maximum(low[xs] - high[ys], low[ys] - high[xs]) <= values_of.allowed(sizes[xs], sizes[ys])
            yield xs[met], ys[met]


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Whole tasks, many small ones at once, and where each begins."""
    left = None
    for batch in batches:
        batch = batch if left is None else pd.concat([left, batch], ignore_index=True)
        task = batch[["key", "i", "j"]].to_numpy()
        starts = [0, *(np.flatnonzero((task[1:] != task[:-1]).any(1)) + 1).tolist()]
        begin = 0
        for k in range(1, len(starts)):
            if starts[k] - starts[begin] >= 4 * CHUNK or k == len(starts) - 1:
                yield batch.iloc[starts[begin] : starts[k]].reset_index(drop=True), [s - starts[begin] for s in starts[begin:k]]
                begin = k
        left = batch.iloc[starts[-1] :]
    if left is not None and len(left):
        yield left.reset_index(drop=True), [0]


def _compared(values_of: type[Values]):
    """Links between members of tasks (key, i, j) that lie together."""

    def compared(group: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        codes, first = pd.factorize(group["id"])
        values = values_of(group["value"].iloc[np.unique(codes, return_index=True)[1]].tolist())
        roots, sizes, out = pd.factorize(group["root"])[0], group["size"].to_numpy(), []
        above = np.arange(len(roots))

        def measure(xs: np.ndarray, ys: np.ndarray, allowed: np.ndarray) -> None:
            linked = _bounds(values, codes[xs], codes[ys], allowed)[1] <= allowed
            for x, y in zip(xs[linked].tolist(), ys[linked].tolist(), strict=True):
                if (r := above[roots[x]]) != (s := above[roots[y]]):
                    above[above == r] = s
                    out.append((first[codes[x]], first[codes[y]]))

        waiting, n = [], 0
        for xs, ys in _meeting(values_of, group, starts):
            apart = above[roots[xs]] != above[roots[ys]]
            xs, ys = xs[apart], ys[apart]
            allowed = values_of.allowed(sizes[xs], sizes[ys])
            met = values.least(codes[xs], codes[ys]) <= allowed
            waiting.append((xs[met], ys[met], allowed[met]))
            n += int(met.sum())
            if n >= PAIRS // 2:  # many at once, but then their links spare the others
                measure(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, n = [], 0
        if n:
            measure(*map(np.concatenate, zip(*waiting, strict=True)))
        return pd.DataFrame(out, columns=["a", "b"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group, starts in _grouped(batches):
            yield compared(group, starts)
        give_back()

    return compare


def _tasks(split: DataFrame) -> DataFrame:
    """The members, once for every pair of chunks that meet as a task (key, i, j). split: members with root and rest, and their
    bucket's n_main and n_rest. Members of a bucket's largest group only meet the rest; the rest also meets itself.
    """
    chunks = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    r = split.withColumn("chunk", F.pmod(F.xxhash64("id"), F.when(F.col("rest"), chunks("n_rest")).otherwise(chunks("n_main"))).cast("int"))
    rest = r.where("rest")
    main = r.where(~F.col("rest")).withColumn("i", F.explode(F.sequence(F.lit(0), chunks("n_rest") - 1))).withColumn("j", -F.col("chunk") - 1)
    with_main = rest.withColumn("i", F.col("chunk")).withColumn("j", F.explode(F.sequence(-chunks("n_main"), F.lit(-1))))
    with_rest = rest.where("n_rest > 1").withColumn("o", F.explode(F.sequence(F.lit(0), chunks("n_rest") - 1))).withColumn("i", F.least("chunk", "o")).withColumn("j", F.greatest("chunk", "o"))
    return main.select(TASK).unionByName(with_main.select(TASK)).unionByName(with_rest.select(TASK))


def link(members: DataFrame, payload: Callable[[DataFrame], DataFrame], values_of: type[Values], once: bool = False) -> DataFrame:
    """members: key BIGINT, id BIGINT, size INT; a row may repeat. payload(ids) gives id, value for a table of ids; with `once` it is called
    only once, for all members that may be compared at all.

    Returns id, root for all ids that are connected with another one by pairs that share a key and are the same.
    """
    dealt = members.repartition("key")
    # all columns, so that both sides of the join read one shuffle
    stats = dealt.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.max("size").alias("s")).where("hub < last and s is not null").select("key", "hub")
    shared = dealt.join(stats.hint("shuffle_hash"), "key").groupBy("key", "hub", "id").agg(F.max("size").alias("size"))
    shared = materialize(shared, "buckets")
    # one of the buckets with the same members, by two sums over their ids
    own = F.col("id") == F.col("hub")
    facts = shared.groupBy("key", "hub").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.max(F.when(own, F.col("size"))).alias("hub_size"))
    buckets = materialize(facts.dropDuplicates(["hub", "n", "x", "y"]).select("key", "hub_size"), "different-buckets")
    rows = shared.where("id != hub").join(buckets, "key").withColumn("near", values_of.near_columns(F.col("size"), F.col("hub_size")))
    rows = materialize(rows, "different-members")
    discard(shared, buckets)
    pairs = materialize(rows.where("near").select(F.col("id").alias("a"), F.col("hub").alias("b"), "size", "hub_size").distinct(), "pairs")
    met = rows.select("id").union(rows.select("hub")) if once else pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    ids = materialize(met.distinct(), "pair-ids")
    values = materialize(payload(ids), "values")
    with_values = pairs.join(values.toDF("b", "y"), "b").join(values.toDF("a", "x"), "a")
    star = materialize(with_values.select("a", "b", "size", "hub_size", "x", "y").mapInPandas(_verified(values_of), "a long, b long, low long, high long, linked boolean"), "star-distances")
    links = star.where("linked").select("a", "b")
    roots = components(links)
    discard(pairs, ids, *() if once else (values,))
    # buckets that still hold several groups besides their hub, which has met them all
    rooted = rows.join(roots, "id", "left").select("key", "hub", "id", "size", F.coalesce("root", "id").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    split = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("main")).where("groups > 1")
    split = split.select("key", F.col("main.root").alias("main"), F.col("main.n").alias("n_main"), (F.col("all") - F.col("main.n")).alias("n_rest"))
    split = rooted.join(split, "key").withColumn("rest", F.col("root") != F.col("main"))
    bounds = star.select(F.col("a").alias("id"), F.col("b").alias("hub"), "low", "high")
    split = split.join(bounds, ["id", "hub"], "left").withColumns({"low": F.coalesce("low", F.lit(0)), "high": F.coalesce("high", F.lit(FAR))})
    tasks = _tasks(split)
    together = lambda t: t.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    tasks = materialize(together(tasks).mapInPandas(_alone(values_of), tasks.schema), "tasks")
    discard(rows)
    if tasks.isEmpty():
        discard(tasks, star, values)
        return roots
    if not once:
        ids = materialize(tasks.select("id").distinct(), "task-ids")
        values = materialize(payload(ids), "values")
    more = materialize(together(tasks.join(values, "id").select(*TASK, "value")).mapInPandas(_compared(values_of), "a long, b long"), "more-links")
    discard(tasks, ids, values)
    if more.isEmpty():
        discard(star, more)
        return roots
    both = components(links.unionByName(more))
    discard(star, more, roots)
    return both
