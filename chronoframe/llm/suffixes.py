"""Removal of byte strings that repeat anywhere in a corpus, by suffix arrays built from linear grouping.

A window is a run of 200 bytes. Its anchor is its 16-byte string with the least hash, so that equal windows have equal anchors at
equal places. Windows are dealt out by their anchor's surroundings: the bytes that all windows of a stretch have in
common. Stretches of windows with a key that occurs once hold no repeated window. Stretches that are equal as a
whole repeat as a whole. The different stretches of a key are cut into blocks of 8 bytes, counted from the anchor, and a suffix array of the blocks brings
stretches with equal runs of blocks together; among these, equal windows are told exactly, byte by byte.

The suffix array is built by grouping. Groups of suffixes, first by their first symbol, are taken in descending order; from each member
the pointer to the previous smaller suffix is followed, and the suffixes pointed to are split from their group,
by how often they are pointed to, into new groups right after it. In the end a group holds the suffixes with one Lyndon prefix.
Within a group, suffixes are ordered by what follows this prefix, the next smaller suffix; so the array is emitted from
its least suffix on, each suffix placing those whose prefix ends where it begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize, partitions, read, text_of, with_text_id
from chronoframe.llm.linking import BROADCAST_IDS, only

WINDOW, GRAM, BLOCK = 200, 16, 8
SPREAD = WINDOW - GRAM  # an anchor begins 0 to SPREAD bytes after its window
HALF = SPREAD // 2
#: Different stretches of one key that a task compares by suffix array; the windows of keys with more are dealt out one by one.
MOST = 1024
#: Bytes of stretches in one suffix array, about.
AT_ONCE = 1 << 18
#: Bytes whose anchors are found at once; bounds the memory for texts of any length.
SLAB = 1 << 22


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence of integers >= 0; the end counts as smaller than any symbol."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = symbols[by_symbol]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(heads, n))
    place = by_symbol.tolist()  # suffixes, group after group
    group_of = np.empty(n, np.int64)
    group_of[by_symbol] = np.repeat(heads, sizes)
    group_of = group_of.tolist()  # the place at which a suffix's group begins
    size = np.zeros(n, np.int64)
    size[heads] = sizes
    size = size.tolist()
    where = np.empty(n, np.int64)
    where[by_symbol] = np.arange(n)
    where = where.tolist()
    smaller = [-1] * n  # the previous smaller suffix

    def split(p: int, moved: dict[int, int]) -> None:
        """Move p to the tail of its group; moved counts, by group, what has gone to its tail."""
        g = group_of[p]
        k = moved.get(g, 0) + 1
        moved[g] = k
        at, to = where[p], g + size[g] - k
        other = place[to]
        place[at], place[to] = other, p
        where[other], where[p] = at, to

    end = n
    while end:
        g = group_of[place[end - 1]]
        members = place[g:end]
        end = g
        if len(members) == 1:
            s = members[0]
            p = s - 1
            while p >= 0 and group_of[p] >= g:
                p = smaller[p]
            smaller[s] = p
            if p < 0:
                continue
            old = group_of[p]
            if size[old] > 1:
                to = old + size[old] - 1
                at, other = where[p], place[to]
                place[at], place[to] = other, p
                where[other], where[p] = at, to
                size[old] -= 1
                size[to] = 1
                group_of[p] = to
            continue
        members.sort()
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group_of[p] >= g:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_count.setdefault(times, []).append(p)
        for times in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for p in by_count[times]:
                split(p, moved)
            for old, k in moved.items():
                if k < size[old]:
                    new = old + size[old] - k
                    size[old] -= k
                    size[new] = k
                    for at in range(new, new + k):
                        group_of[place[at]] = new
    head = list(range(n))  # by a group's beginning, where its next suffix goes
    out = [0] * n
    follower, stop = n, -1  # the empty suffix comes before all
    r = 0
    while True:
        i = follower - 1
        while i != stop:
            g = group_of[i]
            out[head[g]] = i
            head[g] += 1
            i = smaller[i]
        if r == n:
            return np.array(out, np.int64)
        follower, stop = out[r], smaller[out[r]]
        r += 1


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (anchor, first start, last start): runs of windows with one anchor, in slabs of the text."""
    n_windows = len(data) - WINDOW + 1
    for at in range(0, max(0, n_windows), SLAB):
        count = min(SLAB, n_windows - at)
        part = np.frombuffer(data, np.uint8, count + WINDOW - 1, at)
        words = np.lib.stride_tricks.as_strided(part, (len(part) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
        h = words[: len(words) - 8] * np.uint64(0x9E3779B97F4A7C15) ^ words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        # the hash above, the place below: the least is the first of equal ones
        h = (h & np.uint64(~0x7FFFFF & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= SPREAD + 1:
            h = np.minimum(h[: len(h) - span], h[span:])
            span *= 2
        rest = SPREAD + 1 - span
        least = np.minimum(h[: len(h) - rest], h[rest:]) if rest else h
        anchor = (least & np.uint64(0x7FFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        yield anchor[cut] + at, cut + at, np.append(cut[1:] - 1, count - 1) + at


def stretches(data: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(key, hash, first, last) for runs of windows. Equal windows lie in stretches with equal keys; place codes are below."""
    for anchor, first, last in anchors(data):
        for p, a, b in zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True):
            middle = p - HALF
            if b >= middle:  # these windows share the bytes from the anchor on
                lo = max(a, middle)
                yield _hash(data[p : middle + WINDOW], 1), _hash(data[lo : b + WINDOW], (p - lo) << 8 | (p - b)), p << 16 | (p - lo) << 8 | (p - b), 1
            if a < middle:  # these the bytes up to the anchor's end
                hi = min(b, middle - 1)
                yield _hash(data[middle : p + GRAM], 2), _hash(data[a : hi + WINDOW], (p - a) << 8 | (p - hi)), p << 16 | (p - a) << 8 | (p - hi), 2


def _hash(data: bytes, seed: int) -> int:
    h = xxhash.xxh3_64_intdigest(data, seed)
    return h - (1 << 64) if h >> 63 else h


def _unpack(code: int) -> tuple[int, int, int]:
    """anchor, first and last start."""
    p = code >> 16
    return p, p - (code >> 8 & 255), p - (code & 255)


def repeated_windows(pieces: list[bytes], before: list[int]) -> list[list[int]]:
    """Which windows of some stretches repeat. before: a stretch's bytes before its anchor. Returns offsets of windows by stretch.

    Only windows that another stretch, or another place of the same one, holds count.
    """
    aligned = [(b % BLOCK) for b in before]  # blocks are counted from the anchor
    blocks, owner, offset = [], [], []
    for k, (piece, lead) in enumerate(zip(pieces, aligned, strict=True)):
        n = (len(piece) - lead) // BLOCK
        blocks.append(np.frombuffer(piece, ">u8", n, lead).astype(np.uint64))
        owner.append(np.full(n + 1, k))
        offset.append(lead + BLOCK * np.arange(n + 1))
    values, ranks = np.unique(np.concatenate(blocks), return_inverse=True)
    ranks = np.split(ranks + 1, np.cumsum([len(b) for b in blocks])[:-1])
    symbols = np.concatenate([np.append(r, 0) for r in ranks])  # 0 ends a stretch
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    order = suffix_array(symbols)
    # a window holds so many whole blocks at least
    need = (WINDOW - BLOCK + 1) // BLOCK
    room = np.concatenate([np.arange(len(r), -1, -1) for r in ranks])
    fits = room[order] >= need
    same = fits[1:] & fits[:-1]
    for d in range(need):
        at = np.flatnonzero(same)
        same[at] = symbols[order[at] + d] == symbols[order[at + 1] + d]
    found: list[set[int]] = [set() for _ in pieces]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        members = order[lo : hi + 1].tolist()
        for x in range(BLOCK):  # windows that begin x bytes before the block
            seen: dict[bytes, list[tuple[int, int]]] = {}
            for m in members:
                k, s = int(owner[m]), int(offset[m]) - x
                if s >= 0 and s + WINDOW <= len(pieces[k]):
                    seen.setdefault(pieces[k][s : s + WINDOW], []).append((k, s))
            for places in seen.values():
                if len(places) > 1:
                    for k, s in places:
                        found[k].add(s)
    return [sorted(f) for f in found]


def _ranges(starts: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in starts:
        if out and s == out[-1][1] + 1:
            out[-1][1] = s
        else:
            out.append([s, s])
    return [tuple(x) for x in out]


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows key, seg, lead, piece, sorted by key. Emits key, seg and ranges of repeated windows, as offsets from the stretch's begin."""

    def solve(rows: list) -> pd.DataFrame:
        out = [(key, seg, lo, hi) for (key, seg, _, _), starts in zip(rows, repeated_windows([r[3] for r in rows], [r[2] for r in rows]), strict=True) for lo, hi in _ranges(starts)]
        return pd.DataFrame(out, columns=["key", "seg", "lo", "hi"])

    held, size = [], 0
    for batch in batches:
        for row in zip(batch["key"], batch["seg"], batch["lead"], batch["piece"], strict=True):
            if size >= AT_ONCE and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield solve(held)


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            rows = [(key, seg, doc, code) for doc, text in zip(part["doc"], part["text"], strict=True) for key, seg, code, _ in stretches(text.encode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["key", "seg", "doc", "code"])


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows text, wanted (key, seg, code). Emits the stretches' bytes and how many of them come before the anchor."""
    for batch in batches:
        for at in range(0, len(batch), 64):
            out = []
            for text, wanted in zip(batch["text"].iloc[at : at + 64], batch["wanted"].iloc[at : at + 64], strict=True):
                data = text.encode("utf-8", "replace")
                for w in wanted:
                    p, a, b = _unpack(w["code"])
                    out.append((w["key"], w["seg"], p - a, data[a : b + WINDOW]))
            yield pd.DataFrame(out, columns=["key", "seg", "lead", "piece"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows key, seg, lead, piece. Emits every window's digest and offset."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            out = []
            for key, seg, piece in zip(*(batch[c].iloc[at : at + 256] for c in ("key", "seg", "piece")), strict=True):
                out += [(key, seg, s, xxhash.xxh3_128_digest(piece[s : s + WINDOW])) for s in range(len(piece) - WINDOW + 1)]
            yield pd.DataFrame(out, columns=["key", "seg", "at", "digest"])


def covered(texts: DataFrame) -> DataFrame:
    """texts: doc, text. Returns doc, lo, hi: the first and last begin of runs of windows that also begin elsewhere."""
    found = texts.where(F.octet_length("text") >= WINDOW).mapInPandas(_find, "key long, seg long, doc long, code long")
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.min("seg").alias("least"), F.max("seg").alias("most")).where("n > 1")
    keys = materialize(keys.select("key", (F.col("least") != F.col("most")).alias("several")), "repeated-keys")
    repeated = materialize(only(found, keys.select("key"), "key"), "repeated-stretches")
    segs = repeated.groupBy("key", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc", "code")).alias("one"))
    segs = materialize(segs, "stretches")
    whole = segs.where("n > 1").select("key", "seg", F.lit(0).alias("lo"), F.lit(SPREAD).alias("hi"))
    several = segs.groupBy("key").agg(F.count("*").alias("different")).where("different > 1")
    mixed = segs.join(several, "key").select("key", "seg", "different", "one.doc", "one.code")
    wanted = mixed.groupBy("doc").agg(F.collect_list(F.struct("key", "seg", "code")).alias("wanted"))
    few = only(texts, wanted.select("doc"), "doc").dropDuplicates(["doc"])
    pieces = materialize(few.join(wanted, "doc").select("text", "wanted").mapInPandas(_fetch, "key long, seg long, lead int, piece binary"), "stretch-bytes")
    sized = pieces.join(several, "key")
    ranged = "key long, seg long, lo int, hi int"
    small = sized.where(F.col("different") <= MOST).select("key", "seg", "lead", "piece").repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key", "seg")
    some = small.mapInPandas(_compare, ranged)
    # keys with very many different stretches: their windows, one by one
    windows = materialize(sized.where(F.col("different") > MOST).select("key", "seg", "lead", "piece").mapInPandas(_windows, "key long, seg long, at int, digest binary"), "windows")
    twice = windows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    others = windows.join(twice, "digest").select("key", "seg", F.col("at").alias("lo"), F.col("at").alias("hi"))
    ranges = whole.unionByName(some).unionByName(others)
    p, back, forth = F.shiftright("code", 16), F.shiftright("code", 8).bitwiseAND(F.lit(255)), F.col("code").bitwiseAND(F.lit(255))
    lo = p - back + F.col("lo")
    return repeated.distinct().join(ranges, ["key", "seg"]).select("doc", lo.alias("lo"), F.least(p - back + F.col("hi"), p - forth).alias("hi"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, ranges in zip(batch["text"], batch["ranges"], strict=True):
            data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, [r["lo"] for r in ranges], 1)
            np.add.at(change, [r["hi"] + WINDOW for r in ranges], -1)
            gone = np.cumsum(change[:-1]) > 0
            spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
            out.append((len(data), int(gone.sum()), spans, data[~gone].tobytes()))
        made = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
        yield pd.concat([batch[["doc_id"]].reset_index(drop=True), made], axis=1)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept BINARY: the UTF-8 bytes without those of windows that also begin elsewhere.

    One row per row of docs. Null texts are empty. A text that two rows hold is covered wholly if it has 200 bytes. Texts without
    a repeated window are neither shuffled nor handed to Python a second time. Extra columns are left out.
    """
    d = with_text_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), "text", "doc")
    ranges = materialize(covered(d.select("doc", "text")).groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "covered")
    ids = ranges.select("doc")
    if ids.count() <= BROADCAST_IDS:
        hit = d.join(F.broadcast(ids), "doc", "left_semi")
        clean = d.join(F.broadcast(ids), "doc", "left_anti")
    else:
        hit, clean = d.join(ids, "doc", "left_semi"), d.join(ids, "doc", "left_anti")
    cut = hit.join(ranges, "doc").select("doc_id", "text", "ranges").mapInPandas(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    same = clean.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("text", "UTF-8").alias("kept"))
    return cut.unionByName(same)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffixes": op6_suffixes}
