"""Distances of many pairs at once, as large buckets need them."""

import random

import numpy as np
import pandas as pd

from chronoframe.llm import edits, lines, linking, neardup


def test_distances_of_many_pairs():
    """Equal to those of one pair; over what is allowed they may only come out larger."""
    r = np.random.default_rng(5)
    sequences = [r.integers(0, 4, n).astype(np.uint64) << np.uint64(60) for n in (0, 1, 2, 63, 64, 65, 128, 129, 200) for _ in range(4)]
    base = r.integers(0, 900, 300)
    for _ in range(30):
        s = base.copy()
        q = int(r.integers(0, 70))
        s[r.integers(0, 300, q)] = r.integers(0, 900, q)
        sequences.append(np.delete(s, r.integers(0, 300, 4)).astype(np.uint64))
    xs, ys = (a.ravel() for a in np.meshgrid(*[np.arange(len(sequences))] * 2))
    exact = np.array([edits.distance(sequences[x].tolist(), sequences[y].tolist()) for x, y in zip(xs, ys, strict=True)])
    assert (edits.distances(sequences, xs, ys) == exact).all()
    sizes = np.array([len(s) for s in sequences])
    allowed = (0.2 * np.maximum(sizes[xs], sizes[ys])).astype(int)
    banded = edits.distances(sequences, xs, ys, allowed)
    assert ((banded <= allowed) == (exact <= allowed)).all() and (banded >= exact).all() and (banded == exact)[exact <= allowed].all()
    assert (edits.distances(sequences, xs[-3:], ys[-3:]) == -1).all()


def test_large_buckets_are_not_measured_pair_by_pair(monkeypatch):
    """A task of near texts: hardly a pair is measured alone, and the links join the groups that single measurements give."""
    r = random.Random(2)
    for values_of, size_of in ((neardup.Texts, lambda t: len(t.split())), (lines.Lines, len)):
        texts = []
        for k in range(60):
            words = [f"w{r.randrange(10**6)}" for _ in range(40)] if k % 6 == 0 else list(base)
            base = words if k % 6 == 0 else base
            for _ in range(r.randrange(14) if k % 6 else 0):
                words[r.randrange(40)] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(words))
        rows = pd.DataFrame({"key": 1, "i": 0, "j": 0, "id": range(60), "root": range(60), "rest": True, "chunk": 0, "size": [size_of(t) for t in texts], "low": 0, "high": linking.FAR, "value": texts})
        values, alone, measured = values_of(texts), [], values_of.measured
        near = [(x, y) for x in range(60) for y in range(x) if measured(values, x, y)[1] <= values.allowed(values.sizes[x], values.sizes[y])]
        monkeypatch.setattr(values_of, "measured", lambda self, x, y, measured=measured, alone=alone: alone.append(1) or measured(self, x, y))
        links = pd.concat(linking._compared(values_of)(iter([rows])))

        def group(pairs):
            at = list(range(60))
            for x, y in pairs:
                at = [at[y] if a == at[x] else a for a in at]
            return [at.index(a) for a in at]

        assert 0 < len(links) and group(links[["a", "b"]].to_numpy().tolist()) == group(near)
        assert len(alone) <= edits.WORTH * 4


def test_pairs_that_words_align_are_not_measured(monkeypatch):
    """Of long lines with some words changed the alignment of words is enough; distances are measured for the other pairs, the same links result."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for k in range(80):
        x = [word() for _ in range(60)]
        y = [word() if r.random() < (0.05 if k % 4 else 0.5) else w for w in x]
        rows.append((k, 1000 + k, len(" ".join(x)), len(" ".join(y)), " ".join(x), " ".join(y)))
    part = pd.DataFrame(rows, columns=["a", "b", "size", "hub_size", "x", "y"])
    measured, whole = [], linking.distances
    monkeypatch.setattr(linking, "distances", lambda sequences, xs, ys, *more: measured.append(len(xs)) or whole(sequences, xs, ys, *more))
    out = pd.concat(linking._verified(lines.Lines)(iter([part])))
    exact = np.array([edits.distance(x, y) for x, y in zip(part["x"], part["y"], strict=True)])
    allowed = lines.Lines.allowed(part["size"].to_numpy(), part["hub_size"].to_numpy())
    assert (out["linked"].to_numpy() == (exact <= allowed)).all() and out["linked"].sum() == 60
    assert (out["low"].to_numpy() <= exact).all() and (out["high"].to_numpy() >= exact).all()
    assert sum(measured) <= 20


def test_few_long_pairs_are_measured_alone():
    """Blocks of bits pay for many pairs only: the longer the sequences, the more."""
    r = np.random.default_rng(6)
    sequences = [r.integers(0, 4, 600).astype(np.uint64) for _ in range(80)]
    xs, ys = np.arange(0, 80, 2), np.arange(1, 80, 2)
    assert (edits.distances(sequences, xs, ys, worth=12) == -1).all() and (edits.distances(sequences, xs, ys) > 0).all()


def test_lines_are_the_same_by_shuffle_and_by_broadcast(spark, monkeypatch):
    """Texts that meet their lines by a shuffle, with or without a list of the wanted texts, keep the same lines; null ids and repeated rows too."""
    r = random.Random(4)
    pool = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(8)]
    rows = [(k if k % 9 else None, "\n".join(r.choice(pool) + r.choice(["", " x", " yy"]) for _ in range(4))) for k in range(40)]
    docs = spark.createDataFrame([*rows, rows[3], (77, None)], "doc_id long, text string")
    found, asked, link = [], [], lines.link

    def counted(members, payload, values_of, **more):
        return link(members, lambda ids: asked[-1].append(1) or payload(ids), values_of, **more)

    monkeypatch.setattr(lines, "link", counted)
    for places, ids in ((10**6, 10**6), (0, 10**6), (0, 0)):
        monkeypatch.setattr(lines, "BROADCAST_LINES", places)
        monkeypatch.setattr(lines, "BROADCAST_IDS", ids)
        asked.append([])
        found.append(sorted(map(repr, lines.deduplicated(docs).collect())))
    assert found[0] == found[1] == found[2] and any("n_removed=0" not in x for x in found[0])
    assert all(len(x) == 1 for x in asked)  # values are fetched once
