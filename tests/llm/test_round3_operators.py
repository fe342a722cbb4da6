"""Clustering, exact top-k search and resampling against brute force, with nulls, ties, copies, odd values and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import clustering, crc, resampling, topk

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v string, row int, query int"


def vectors_of(spark, rows):
    """With columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, x, 0, "x", "y", 1, 2) for i, x in rows], VECTORS)


def test_crc_of_spans():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 50_000, dtype=np.uint8)
    lengths = np.concatenate([rng.choice([1, 2, 3, 17, 127, 128, 129, 255, 256, 257, 383, 385, 2000], 500), [50_000]])
    starts = np.array([rng.integers(0, len(data) - n + 1) for n in lengths])
    whole = data.tobytes()
    assert [int(x) for x in crc.crc32_of_spans(data, starts, lengths)] == [zlib.crc32(whole[s : s + n]) for s, n in zip(starts, lengths, strict=True)]
    assert len(crc.crc32_of_spans(data, starts[:0], lengths[:0])) == 0


def features_of(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def words(seed, n, letters="abcdeABé漢1"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 4))) + r.choice(["", ".", " -", "\n"]) for _ in range(n))


ODD = [None, "", " .,\n", "a", "A b", "x" * 700 + " y " + "z" * 300 + "é" * 400, "a\0b--c\x7fd", words(1, 900), words(2, 30), words(2, 30)]


@pytest.mark.parametrize("size", [1 << 18, 64, 5])
def test_features_in_groups_and_pieces(size):
    got, counted = [Counter() for _ in ODD], [0] * len(ODD)
    for first, rows, text, bucket, n in resampling.slices(pa.array(ODD), size=size):
        for t, b in zip(text, bucket, strict=True):
            got[first + t][int(b)] += 1
        for i in range(rows):
            counted[first + i] += int(n[i])
    assert [(n, c) for n, c in zip(counted, got, strict=True)] == [(n, Counter(f)) for n, f in map(features_of, ODD)]


def resampled(rows, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features_of(x)[1])
    for x in target:
        t.update(features_of(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, x in rows:
        n, f = features_of(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted([r for r in out if r[1] >= least], key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return out, drawn


def test_resampling(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, words(9, 40)), (5, words(8, 50)), (5, words(8, 50))] + [(100 + k, words(k, 15 + k % 30)) for k in range(200)]
    docs = spark.createDataFrame([(i, t, "s", 1, "w") for i, t in rows], "doc_id long, text string, source string, weight int, rank string")
    target = [words(k, 60, "abc") for k in range(5)] + [None, ""]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    expected, drawn = resampled(rows, target)
    got = resampling.resample(docs, goal).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in got) == sorted((str(i), f, w, s) for i, _, f, w, s in expected)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[4]) for r in drawn] and len(drawn) == sum(n >= 20 for _, n, *_ in expected) * 5 // 100 > 3
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert resampling.resample(named, goal).count() == len(rows)
    assert resampling.resample(docs.limit(0), goal).count() == 0 and resampling.resample(docs.limit(3), goal.limit(0)).count() == 3


def clustered(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((d(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    sums = Counter()
    for _, c, x in found:
        sums[c] += x
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, x, sums[c], sum(sums.values()), sha[c]) for i, c, x in found]


def test_clustering(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 64))
    rows = [(k, [float(x) for x in centres[k % 5] + rng.normal(size=64) * 0.2]) for k in range(300)]
    rows += [(300 + k, [0.5] * 64) for k in range(150)]  # a third are copies
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, [None] + [0.0] * 63), (906, [0.0] * 64), (None, [1.0] * 64), (7, [2.0] * 64)]
    got = clustering.cluster(vectors_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(clustered(rows), key=str)
    few = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-1.0] * 64)]
    assert sorted(map(tuple, clustering.cluster(vectors_of(spark, few)).collect())) == sorted(clustered(few))
    assert clustering.cluster(vectors_of(spark, rows[-9:-3])).count() == 0 and clustering.cluster(vectors_of(spark, [])).count() == 0


def test_pivots_leave_centroids_out():
    """Well parted vectors are measured against few centroids, and the nearest is found all the same."""
    rng = np.random.default_rng(5)
    centroids = rng.integers(-4000, 4000, (8, 64))
    v = centroids[rng.integers(0, 8, 1000)] + rng.integers(-50, 50, (1000, 64))
    pivots = clustering.choose_pivots(v[:200])
    best, distance, computed = clustering.assigned(v, np.sqrt(clustering.squared(v, pivots).astype(float)), centroids, pivots)
    exact = clustering.squared(v, centroids)
    assert (best == exact.argmin(1)).all() and (distance == exact.min(1)).all() and computed < 2000


def nearest_by_product(rows, k=5, step=50):
    first = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            first[i] = min(first.get(i, q), q)
    out = []
    for i, q in first.items():
        if i % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), j) for j, v in first.items() if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return out


@pytest.mark.parametrize("slices", [2, 3])
def test_topk(spark, slices):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=16)]) for k in range(400)]
    rows += [(400 + k, [0.25] * 16) for k in range(200)]  # a third are copies
    rows += [(600 + k, [float(x) for x in rng.integers(-1, 2, 16)]) for k in range(101)]  # many equal scores
    rows += [(750, [0.0] * 16), (800, [1.0] + [0.0] * 15), (850, [1.0, 2.0]), (851, [2.0, 1.0]), (900, [3.0]), (950, [])]
    rows += [(951, None), (1000, [float("nan")] * 16), (1050, [None] * 16), (None, [9.0] * 16), (3, [9.0] * 16), (50, [-9.0] * 16)]
    got = topk.search(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, slices=slices, shard=100, block=5).collect()
    assert sorted(map(tuple, got)) == sorted(nearest_by_product(rows))


def test_topk_of_little_and_large(spark):
    assert topk.search(vectors_of(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(vectors_of(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [200_000.0, 3.0]), (1, [-200_000.0, 1.0]), (2, [199_999.0, 1.0]), (50, [0.5, -0.5])]
    got = topk.search(vectors_of(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(nearest_by_product(rows))
