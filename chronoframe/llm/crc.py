"""CRC-32 of many spans of a buffer at once, from a table of what a byte contributes at each distance from a span's end.

The register of a CRC is linear over XOR: a span's remainder is the XOR of what each of its bytes contributes at its distance from the
end, and of a constant that depends on the length alone. A span longer than the table is cut into blocks from its end; a block's
remainder is carried past the blocks that follow it by tables that move the register over a power of two of blocks.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Fixed value: the polynomial of CRC-32, bits reversed.
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the table holds; bytes that are looked up at once.
WIDTH, CHUNK = 128, 1 << 16


@functools.cache
def _step() -> np.ndarray:
    """What the register becomes when one of its low bytes leaves it."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


@functools.cache
def positions() -> np.ndarray:
    """Contribution of a byte at a distance from the end: entry distance * 256 + byte, distances from 1 (the last byte) to WIDTH."""
    rows = [np.zeros(256, np.uint32), _step()]
    while len(rows) <= WIDTH:
        rows.append((rows[-1] >> 8) ^ _step()[rows[-1] & 255])
    return np.concatenate(rows)


@functools.cache
def constants() -> np.ndarray:
    """The CRC of so many zero bytes: what a length adds to the contributions."""
    return np.array([zlib.crc32(bytes(n)) for n in range(WIDTH + 1)], np.uint32)


@functools.cache
def _past(level: int) -> np.ndarray:
    """4 x 256: what each byte of a register becomes after WIDTH << level zero bytes."""
    if level:
        half = _past(level - 1)
        return _moved(half, half)
    t = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(WIDTH):
        t = (t >> 8) ^ _step()[t & 255]
    return t


def _moved(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _contributions(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XOR over each span of at most WIDTH bytes, without the length's constant."""
    out, ends, first = np.empty(len(starts), np.uint32), np.cumsum(lengths), 0
    while first < len(starts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        n = lengths[first:last]
        until = ends[first:last] - before
        at = np.arange(until[-1])
        byte = data[at + np.repeat(starts[first:last] - (until - n), n)]
        entry = ((np.repeat(until, n) - at) << 8) + byte
        out[first:last] = np.bitwise_xor.reduceat(positions()[entry], until - n)
        first = last
    return out


def crc32_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start : start + length] for each span; spans may overlap and have at least one byte."""
    if not len(starts):
        return np.empty(0, np.uint32)
    blocks = -(-lengths // WIDTH)
    if blocks.max() == 1:
        return _contributions(data, starts, lengths) ^ constants()[lengths]
    span = np.repeat(np.arange(len(starts)), blocks)
    behind = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(span))  # blocks between this one and the span's end
    end = (starts + lengths)[span] - behind * WIDTH
    begin = np.maximum(starts[span], end - WIDTH)
    crc, level = _contributions(data, begin, end - begin), 0
    while behind.max():
        odd = np.flatnonzero(behind & 1)  # each stands right before the even one that it is folded into
        crc[odd + 1] ^= _moved(_past(level), crc[odd])
        even = behind & 1 == 0
        crc, behind, level = crc[even], behind[even] >> 1, level + 1
    long = lengths > WIDTH
    added = constants()[np.where(long, 0, lengths)]
    sizes, which = np.unique(lengths[long], return_inverse=True)
    zeros, run = np.empty(len(sizes), np.uint32), 0
    for k, n in enumerate(sizes):
        for part in range(int(sizes[k - 1]) if k else 0, int(n), CHUNK):
            run = zlib.crc32(bytes(min(CHUNK, int(n) - part)), run)
        zeros[k] = run
    added[long] = zeros[which]
    return crc ^ added
