"""Edit distances of sequences."""

from __future__ import annotations

import numpy as np

#: Words behind the furthest diagonal within which others are followed.
BEHIND = 12
#: Of many pairs at once: blocks of 64 that the shorter sequence has at most, pairs that are worth it at least, and places of longer sequences in memory.
BLOCKS, WORTH, PLACES = 32, 16, 1 << 21


def distance(a, b) -> int:
    """Levenshtein distance, one column at a time in the bits of two integers."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    plus, minus, out = mask, 0, len(a)
    for c in b:
        eq = at.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(d | plus) & mask, plus & d
        out += bool(up & top) - bool(down & top)
        up, down = (up << 1) | 1, down << 1
        plus, minus = (down | ~(x | up)) & mask, up & x & mask
    return out


def distances(sequences: list[np.ndarray], xs: np.ndarray, ys: np.ndarray, allowed: np.ndarray | None = None, worth: int = 0) -> np.ndarray:
    """Levenshtein distances of many pairs of sequences of numbers, given by position; -1 where a pair is too long, or in company too small, to be
    measured so: under WORTH pairs, or under `worth` for each block of the longest one. The columns of distance(), those of all pairs of a batch at once, in blocks of 64 bits.

    A distance over what is allowed may come out larger than it is: blocks that no way within it enters are left out."""
    sizes = np.array([len(s) for s in sequences], np.int64)
    swap = sizes[xs] > sizes[ys]
    short, long = np.where(swap, ys, xs), np.where(swap, xs, ys)
    out = np.where(sizes[short] == 0, sizes[long], -1)
    todo = np.flatnonzero((out < 0) & (sizes[short] <= 64 * BLOCKS))
    todo = todo[np.lexsort((sizes[long[todo]], -(-sizes[short[todo]] // 64)))]
    begin = 0
    while begin < len(todo):
        end = begin + 1  # at most twice the blocks of the first, and no more places than memory is meant for
        most = 2 * -(-sizes[short[todo[begin]]] // 64)
        width = np.maximum.accumulate(sizes[long[todo[begin : begin + PLACES]]])
        fits = (width * np.arange(1, len(width) + 1) <= PLACES) & (sizes[short[todo[begin : begin + PLACES]]] <= 64 * most)
        end = begin + max(1, int(np.argmin(fits)) if not fits.all() else len(fits))
        if end - begin >= max(WORTH, worth * int(-(-sizes[short[todo[end - 1]]] // 64))):
            out[todo[begin:end]] = _columns(sequences, short[todo[begin:end]], long[todo[begin:end]], sizes, None if allowed is None else int(allowed[todo[begin:end]].max()))
        begin = end
    return out


def _columns(sequences: list[np.ndarray], short: np.ndarray, long: np.ndarray, sizes: np.ndarray, band: int | None) -> np.ndarray:
    order = np.argsort(-sizes[long], kind="stable")  # pairs whose columns go on come first
    short, long = short[order], long[order]
    n, m = sizes[short], sizes[long]
    used, at = np.unique(np.concatenate([short, long]), return_inverse=True)
    codes = np.unique(np.concatenate([sequences[k] for k in used]), return_inverse=True)[1].astype(np.int64)
    ends = np.cumsum(sizes[used])
    begins, kinds = ends - sizes[used], int(codes.max()) + 1
    row, column = at[: len(short)], at[len(short) :]
    # where each element stands in each shorter sequence
    own = np.unique(row)
    places = np.concatenate([np.arange(sizes[used[k]]) for k in own])
    keys, which = np.unique(np.concatenate([k * kinds + codes[begins[k] : ends[k]] for k in own]), return_inverse=True)
    blocks = int(-(-n.max() // 64))
    masks = np.zeros((blocks, len(keys) + 1), np.uint64)
    np.bitwise_or.at(masks, (places >> 6, which), np.uint64(1) << (places & 63).astype(np.uint64))
    steps = np.minimum(np.arange(m[0])[None, :], m[:, None] - 1)
    wanted = row[:, None] * kinds + codes[begins[column][:, None] + steps]
    found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found[keys[found] != wanted] = len(keys)
    found = np.ascontiguousarray(found.T.astype(np.int32))
    del wanted, steps
    plus, minus = np.full((blocks, len(n)), ~np.uint64(0)), np.zeros((blocks, len(n)), np.uint64)
    going = len(n) - np.searchsorted(m[::-1], np.arange(m[0]), "right")
    one, last = np.uint64(1), np.uint64(63)
    band = int(m[0]) if band is None else band
    buffers = np.empty((7, len(n)), np.uint64)
    for j, k in enumerate(going.tolist()):
        eq, x, h, up, down, up_in, down_in = buffers[:, :k]
        at_j = found[j, :k]
        up_in[:], down_in[:] = 1, 0
        for b in range(max(0, (j - band) // 64), min(blocks, (j + band) // 64 + 1)):
            p, d = plus[b, :k], minus[b, :k]
            np.take(masks[b], at_j, out=eq, mode="clip")
            np.bitwise_or(eq, d, out=x)
            np.bitwise_or(eq, down_in, out=eq)
            np.bitwise_and(eq, p, out=h)
            np.add(h, p, out=h)
            np.bitwise_xor(h, p, out=h)
            np.bitwise_or(h, eq, out=h)
            np.bitwise_or(h, p, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, d, out=up)
            np.bitwise_and(p, h, out=down)
            # what goes on into the next block, before both move down by one
            np.right_shift(up, last, out=eq)
            np.right_shift(down, last, out=h)
            np.left_shift(up, one, out=up)
            np.bitwise_or(up, up_in, out=up)
            np.left_shift(down, one, out=down)
            np.bitwise_or(down, down_in, out=down)
            np.bitwise_and(up, x, out=d)
            np.bitwise_or(up, x, out=x)
            np.invert(x, out=x)
            np.bitwise_or(down, x, out=p)
            eq, h, up_in, down_in = up_in, down_in, eq, h
    # the last column: its top is m, the rest are steps of one
    bits = np.clip(n[None, :] - 64 * np.arange(blocks)[:, None], 0, 64)
    inside = np.where(bits == 64, ~np.uint64(0), (one << np.minimum(bits, 63).astype(np.uint64)) - one)
    out = np.empty(len(n), np.int64)
    out[order] = m + np.bitwise_count(plus & inside).astype(np.int64).sum(0) - np.bitwise_count(minus & inside).astype(np.int64).sum(0)
    return out


def some_alignment(a: list[str], b: list[str], allowed: int) -> int | None:
    """Characters that some way to edit the words a into the words b takes, if one within `allowed` is found; None tells nothing.

    For 0, 1, 2, ... edited words the furthest word that each diagonal reaches is worked out, but only on diagonals that are close behind
    the one that has come furthest, and with it the characters that its edits cost at most.
    """
    n, m = len(a), len(b)
    low, reach, cost = 0, [0], [0]
    for _ in range(allowed + 1):
        best = 0
        for i, x in enumerate(reach):
            y = x - low - i
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            reach[i] = x
            if x + y > best:
                best = x + y
            if x == n and y == m and cost[i] <= allowed:
                return cost[i]
        first, last = 0, len(reach) - 1
        while first < last and (2 * reach[first] - low - first < best - BEHIND or cost[first] > allowed):
            first += 1
        while last > first and (2 * reach[last] - low - last < best - BEHIND or cost[last] > allowed):
            last -= 1
        if cost[first] > allowed and first == last:
            return None
        kept, paid, low = reach[first : last + 1], cost[first : last + 1], low + first - 1
        reach, cost = [], []
        for i in range(len(kept) + 2):
            k, x, c = low + i, -1, allowed + 1
            if 1 <= i <= len(kept):  # a word is exchanged
                at = kept[i - 1]
                if at < n and at - k < m:
                    x, c = at + 1, paid[i - 1] + max(len(a[at]), len(b[at - k]))
            if i >= 2 and kept[i - 2] < n and kept[i - 2] + 1 > x:  # one of a is left out
                x, c = kept[i - 2] + 1, paid[i - 2] + len(a[kept[i - 2]]) + 1
            if i < len(kept) and kept[i] > x and 0 <= kept[i] - k <= m:  # one of b is put in
                x, c = kept[i], paid[i] + len(b[kept[i] - k - 1]) + 1
            reach.append(x if x >= 0 else max(0, k))
            cost.append(c)
        while len(reach) > 1 and cost[0] > allowed:
            reach.pop(0)
            cost.pop(0)
            low += 1
        while len(reach) > 1 and cost[-1] > allowed:
            reach.pop()
            cost.pop()
    return None


def banded(a: list, b: list, allowed: int) -> int | None:
    """Levenshtein distance if it is at most `allowed`, else None. For 0, 1, 2, ... edits the furthest row that each diagonal within
    them reaches is worked out, so that time grows with the square of the distance, not with the lengths."""
    n, m = len(a), len(b)
    if abs(n - m) > allowed:
        return None
    reach = {}
    for d in range(allowed + 1):
        new = {}
        for k in range(-d, d + 1):
            if k > n or -k > m:
                continue
            x = max(reach.get(k, -1) + 1, reach.get(k + 1, -1), reach.get(k - 1, -2) + 1) if d else 0
            x = min(x, n, m + k)
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            new[k] = x
            if x >= n and x - k >= m:
                return d
        reach = new
    return None


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequences without what they begin and end with alike."""
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    return a[: len(a) - tail], b[: len(b) - tail]
