"""Best-fit packing of tokenised documents with swap-based local search.

Documents become pieces of at most one sequence's length. Pieces are dealt into shards of bounded size; every shard places
its pieces best-fit, longest first, and then empties sequences by local search: a piece moves to another sequence,
or changes places with one or two shorter pieces there, whenever that raises the sum of squared fills. Well-filled sequences
stay; the pieces of the others are dealt anew into fewer shards and packed again, until one round has been run on one shard or
no more than a shard's worth is left.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import give_back, materialize, partitions, read, text_of

CAPACITY, END = 4096, 1
#: Pieces in a shard, and the fill from which a sequence is left alone after a round.
SHARD, GOOD = 8192, 0.995
#: Words that a worker keeps the ids of.
KEPT_WORDS = 300_000
#: Unseen words that go to the tokenizer at once; characters of texts that are taken together.
TOGETHER, AT_ONCE = 1000, 1 << 20

_encoders: dict = {}

#: Characters that lower-case, normalise and split alike in every Unicode version: printable Latin with line ends and tabs.
_PLAIN = "\t\n\r" + "".join(chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250)))


def _splitter():
    """The tokenizer's own split into contractions, letters, single digits and other characters, for lower-cased plain texts.

    The classes of letters and numbers are spelt out for them, which the standard library's engine matches fastest.
    """
    import regex

    lower = sorted(set(_PLAIN.lower()))
    letters, numbers = ("".join(re.escape(c) for c in lower if regex.match(kind, c)) for kind in (r"\p{L}", r"\p{N}"))
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\s{letters}{numbers}]+").findall


class _Words(dict):
    """Ids of the tokenizer's pre-tokens, as little-endian bytes; the least recent half goes when there are too many."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def _encoded(self, words: list[str]) -> Iterator[bytes]:
        """Each word's ids. Words are handed over many at once, with spaces between: most of a call's cost does not depend on its text."""
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids, word = np.array(found.ids, "<u4").tobytes(), np.array(found.word_ids, np.int64)
        cuts = [0, *(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), len(ids)]
        if len(cuts) == len(words) + 1:
            return (ids[i:j] for i, j in zip(cuts, cuts[1:], strict=False))
        return (np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words)

    def learn(self, words: list[str]) -> None:
        """Make sure that all these words are here."""
        new = [w for w in dict.fromkeys(words) if w not in self]
        if len(self) + len(new) > KEPT_WORDS:
            for old in list(self)[: max(len(self) // 2, len(self) + len(new) - KEPT_WORDS)]:
                del self[old]
            new = [w for w in dict.fromkeys(words) if w not in self]
        for k in range(0, len(new), TOGETHER):
            part = new[k : k + TOGETHER]
            self.update(zip(part, self._encoded(part), strict=True))


def encoder(path: str):
    """A function texts -> ids of each as little-endian unsigned 32-bit bytes, equal to the tokenizer's own for every text.

    The tokenizer splits a text into words before it looks for merges, so a word's ids do not depend on its surroundings and are
    kept. Texts with characters outside plain Latin, or with a special token's spelling, go to the tokenizer whole.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        plain, split, kept = re.compile(f"[{re.escape(_PLAIN)}]*").fullmatch, _splitter(), _Words(tokenizer)

        def together(texts: list[str]) -> Iterator[bytes]:
            words = [None if "<|" in text or not plain(text) else split(text.lower()) for text in texts]
            kept.learn([w for ws in words if ws for w in ws])
            for text, ws in zip(texts, words, strict=True):
                yield np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if ws is None else b"".join(map(kept.__getitem__, ws))

        def encode(texts: Iterable[str]) -> Iterator[bytes]:
            held, size = [], 0
            for text in texts:
                held.append(text)
                size += len(text)
                if size >= AT_ONCE:
                    yield from together(held)
                    held, size = [], 0
            yield from together(held)

        _encoders[path] = encode
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids BINARY (little-endian unsigned 32 bits); key, unique in effect.

    Null texts are empty and give the end id alone. Extra columns are left out. Ids are of any type that its text gives back, nulls too.
    """
    schema = "doc_id string, piece int, start long, length long, ids_crc32 long, key long" + ", ids binary" * with_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer), np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch["doc_id"], encode(batch["text"]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            out = pd.DataFrame(rows, columns=names)
            out["key"] = np.int64(0)
            yield out[["doc_id", "piece", "start", "length", "ids_crc32", "key", *["ids"] * with_ids]]
        give_back()

    kind = docs.select(id_col).schema[0].dataType
    d = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_of(text_col).alias("text"))
    # a doc_id may repeat: what tells rows apart is their place in the written table
    return d.mapInPandas(run, schema).withColumns({"doc_id": F.col("doc_id").cast(kind), "key": F.monotonically_increasing_id()})


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Positions by bin: longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([int(i)])
            free, b = capacity - n, len(bins) - 1
        else:
            free, b = room.pop(at)
            bins[b].append(int(i))
            free -= n
        if free:
            insort(room, (free, b))
    return bins


class _Swaps:
    """What the underfull bins offer in exchange: nothing (for a plain move), every single piece and every pair of pieces, with the room behind it.

    The offers of all bins lie in one table; a bin that changes leaves its old rows behind as void and adds new ones.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.bins, self.lengths, self.capacity = bins, lengths, capacity
        self.void = 2 * capacity
        self.fill = np.array([int(sum(lengths[i] for i in b)) for b in bins], np.int64)
        self.table, self.used = np.empty((0, 4), np.int64), 0  # length, bin, piece, second piece (-1: none)
        self.rows: dict[int, tuple[int, int]] = {}
        for j in range(len(bins)):
            self.offer(j)

    def offer(self, j: int) -> None:
        """Put bin j's offers into the table in place of its earlier ones; empty and full bins offer nothing."""
        if j in self.rows:
            begin, end = self.rows.pop(j)
            self.table[begin:end, 0] = self.void
        if not self.bins[j] or self.fill[j] == self.capacity:
            return
        items = np.array(self.bins[j], np.int64)
        x, y = np.triu_indices(len(items), 1)
        n = self.lengths[items]
        size, none = np.concatenate([[0], n, n[x] + n[y]]), np.full(1 + len(items), -1)
        new = np.stack([size, np.full(len(size), j), np.concatenate([[-1], items, items[x]]), np.concatenate([none, items[y]])], 1)
        if self.used + len(new) > len(self.table):
            self._grow(len(new))
        self.table[self.used : self.used + len(new)] = new
        self.rows[j] = (self.used, self.used + len(new))
        self.used += len(new)

    def _grow(self, more: int) -> None:
        """Drop void rows and make room for as many again."""
        live = self.table[: self.used]
        live = live[live[:, 0] != self.void]
        starts = np.flatnonzero(np.diff(live[:, 1], prepend=-1))
        self.rows = {int(live[a, 1]): (int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(live)], strict=True)} if len(live) else {}
        self.table, self.used = np.concatenate([live, np.empty((len(live) + 2 * more + 1024, 4), np.int64)]), len(live)

    def step(self, k: int) -> bool:
        """The exchange of bin k that raises the sum of squared fills most, if one does."""
        table = self.table[: self.used]
        size, to = table[:, 0], table[:, 1]
        fill = self.fill[to]
        most = np.where(to == k, 0, self.capacity - fill + size)  # what fits into the other bin against this offer
        ahead = fill - self.fill[k] - size
        own = self.bins[k]
        gives = {int(self.lengths[i]): [i] for i in own}
        gives = [*gives.items(), *{int(self.lengths[i] + self.lengths[j]): [i, j] for x, i in enumerate(own) for j in own[x + 1 :]}.items()]
        best, found = 0, None
        for given, give in gives:
            # squares grow by 2 * gain * (other's fill - own fill + gain); two pieces go for one piece at most
            fits = (given <= most) & (given > size) & (given + ahead > 0)
            at = np.flatnonzero(fits if len(give) == 1 else fits & (table[:, 3] < 0))
            if len(at):
                gain = (given - size[at]) * (given + ahead[at])
                if gain.max() > best:
                    best, found = int(gain.max()), (given, give, table[at[gain.argmax()]].copy())
        if found is None:
            return False
        given, give, (taken, j, *back) = found
        back = [int(i) for i in back if i >= 0]
        self.bins[k] = [i for i in own if i not in give] + back
        self.bins[j] = [i for i in self.bins[j] if i not in back] + give
        self.fill[k] -= given - taken
        self.fill[j] += given - taken
        self.offer(int(j))
        self.offer(k)
        return True


def fewest(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: they hold all tokens, and pieces over half a bin never share one."""
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by exchanges that raise the sum of squared fills, the emptiest bin first.

    From bin k, a piece moves into another underfull bin; or one piece, or two, change places with one or two shorter pieces there
    (one for one, one for two, two for one). The other bin may be less full than k, as long as the sum of squares grows: bins with large
    pieces get smaller ones for them, until these bins' room is worth a piece. Bins are passed over again until a pass empties
    none, or no packing has fewer bins.
    """
    state = _Swaps(bins, lengths, capacity)
    least, left = fewest(lengths, capacity), len(bins)
    before = left + 1
    while least < left < before:
        before = left
        for k in np.argsort(state.fill, kind="stable").tolist():
            if not state.bins[k]:
                continue
            while state.bins[k] and state.fill[k] < capacity and state.step(k):
                pass
            left -= not state.bins[k]  # only the bin that gives can become empty
            if left <= least:
                break
    return [b for b in state.bins if b]


def pack_shard(key: np.ndarray, lengths: np.ndarray, capacity: int) -> pd.DataFrame:
    order = np.argsort(key, kind="stable")  # the result does not depend on the order of arrival
    key, lengths = key[order], lengths[order]
    bins = local_search(best_fit(lengths, capacity), lengths, capacity)
    rows = [(key[i], b, place, fill) for b, items in enumerate(bins) for fill in [int(sum(lengths[i] for i in items))] for i, place in zip(items, np.cumsum([0, *[lengths[i] for i in items]]), strict=False)]
    return pd.DataFrame(rows, columns=["key", "bin", "offset", "fill"])


def _packer(capacity: int, base: int, stride: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf["key"].to_numpy(), pdf["length"].to_numpy(), capacity).merge(pdf[["key", "length"]], on="key")
        out["sequence_id"] = base + int(pdf["shard"].iloc[0]) * stride + out["bin"]
        return out[["key", "length", "sequence_id", "offset", "fill"]]

    return run


def pack(lengths: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = 3) -> DataFrame:
    """lengths: key BIGINT, unique, and length BIGINT, 1 to capacity. Returns key, sequence_id, offset.

    Groups of exactly one full piece are sequences of their own and are never shuffled. An empty table gives an empty result.
    """
    full = lengths.where(F.col("length") >= capacity).select("key", (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = lengths.where(F.col("length") < capacity).select("key", "length")
    done = [full]
    schema = "key long, length long, sequence_id long, offset long, fill long"
    base = 0
    for round_ in range(rounds):
        n = left.count()
        if not n:
            break
        shards = -(-n // shard)
        last = round_ == rounds - 1 or shards == 1

        dealt = left.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(round_)), F.lit(shards)))
        packed = materialize(dealt.groupBy("shard").applyInPandas(_packer(capacity, base, shard * 4), schema), "pack-round")
        base += shards * shard * 4
        keep = F.lit(True) if last else F.col("fill") >= F.lit(int(GOOD * capacity))
        done.append(packed.where(keep).select("key", "sequence_id", "offset"))
        if last:
            break
        left = packed.where(~keep).select("key", "length")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): where every piece of every document goes."""
    cut = materialize(pieces(docs, tokenizer, capacity, id_col, text_col, with_ids), "pack-pieces")
    return cut.join(pack(cut.select("key", "length"), capacity), "key").drop("key")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_packing": op3_packing}
