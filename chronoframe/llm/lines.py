"""Line deduplication: SimHash and MinHash buckets of normalised lines, edit similarity, one occurrence per connected group.

A line is normalised to its words in lower case. Lines with equal words are one. Lines that share a bucket are linked if their
edit similarity is 0.8 or more. Of every connected group the first occurrence stays, by doc_id and line.

The buckets of a line are: the two blocks of its 64-bit SimHash over n-grams of bytes, of which one agrees if at most one bit
differs; bands of MinHashes over the same n-grams, since the SimHashes of most pairs of similarity 0.8 differ in more; and for short
lines all that is left after deleting as many characters as the similarity allows, which finds every pair of short lines. n-grams are shorter for
shorter lines; lines between have both, so that a pair of similar lines always has a length of n-grams in common. All pairs
that share a bucket count; what else is known of two lines (lengths, characters, distances from a third) only spares work where it rules similarity out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import discard, give_back, materialize, read, text_of
from chronoframe.llm.edits import distance, some_alignment
from chronoframe.llm.linking import BROADCAST_IDS, link, only
from chronoframe.llm.neardup import _mix

#: Blocks of a SimHash, how many make a key; similarity; and the length up to which short lines are found for certain.
BLOCKS, TAKEN, SIMILARITY, SHORT = 2, 1, 0.8, 14
#: n-gram lengths with the least and most bytes of a line that has them, MinHashes to a band, and bands. A range starts at or below 0.8 of the end before.
GRAMS, BAND, BANDS = ((4, 12, 80), (8, 64, 1 << 62)), 4, 10
#: Bytes that are prepared at once, besides a longer text's; lines that a task remembers to have sent.
AT_ONCE, SENT = 1 << 18, 100_000
#: Places of lines up to this many are broadcast (some 30 bytes each) to find them in the documents; more are joined by a shuffle. So few that tables
#: of 0.1 GB already run as those of 30 GB do.
BROADCAST_LINES = 5_000
_EDGES = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
_MASKS = [sum(((1 << (_EDGES[b + 1] - _EDGES[b])) - 1) << _EDGES[b] for b in pair) for pair in combinations(range(BLOCKS), TAKEN)]
_FACTOR, _SALT = 0x5851F42D4C957F2D, 0xD6E8FEB86659FD93
_ODD = _mix(np.arange(1, BAND * BANDS + 1, dtype=np.uint64) * np.uint64(_SALT)) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFF)


#: Letters, digits, underscores and all beyond ASCII stay, line feeds too; the rest separates words.
_WORDS = bytes(c if c > 127 or c == 10 or chr(c).isalnum() or c == 95 else 32 for c in range(256))


def _separated(text: str) -> list[bytes]:
    """The lines of a text in lower case, in UTF-8, with spaces for all that separates words."""
    return text.lower().encode("utf-8", "replace").translate(_WORDS).split(b"\n")


def normalised(text: str) -> list[bytes]:
    """The normalised lines of a text, in UTF-8."""
    return [b" ".join(line.split()) for line in _separated(text)]


def characters(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode())


def digests(lines: list[bytes]) -> np.ndarray:
    """128 bits of every line, as two numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)


def _grams(lines: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of n = 4 or 8 bytes of lines of at least n, one after another, where each line's begin, and how many they are."""
    data, sizes = b"".join(lines), np.array([len(x) for x in lines])
    h = np.ndarray(len(data) - n + 1, f"<u{n}", data, strides=(1,))
    counts, within, ends = sizes - n + 1, np.ones(len(h), bool), np.cumsum(sizes)[:-1]
    for k in range(1, n):
        within[ends - k] = False
    h = h[within].astype(np.uint64)
    h *= np.uint64(_FACTOR)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_SALT)
    h ^= h >> np.uint64(29)
    return h, np.cumsum(counts) - counts, counts


def _simhash(h: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A bit is set if over half of a line's n-grams have it. Bits are summed in lanes of 8, at most 255 n-grams at once."""
    pieces = -(-counts // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(begin, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.zeros(len(begin), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        out |= (2 * ones > counts[:, None]).astype(np.uint8).view(np.uint64).ravel() << np.uint64(k)
    return out


def _minhashes(h: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BAND * BANDS MinHashes of each line. Lines of many n-grams deal these to as many bins and take the least of each bin, empty bins
    that of the next one that is not; a short line takes the least under so many hashes."""
    n = BAND * BANDS
    if counts.min() < n:
        out = np.empty((len(begin), n), np.uint64)
        for k in range(n):
            out[:, k] = np.minimum.reduceat(h * _ODD[k], begin)
        return out
    low = np.full(len(begin) * n, _NONE, np.uint64)
    bins = (h >> np.uint64(32)) * np.uint64(n)
    bins >>= np.uint64(32)
    bins += np.repeat(np.arange(len(begin), dtype=np.uint64) * np.uint64(n), counts)
    np.minimum.at(low, bins.view(np.int64), h & _NONE)
    low = low.reshape(-1, n)
    out, empty, step = low.copy(), low == _NONE, 0
    while empty.any() and step < n:
        step += 1
        following = np.roll(low, -step, axis=1)
        fill = empty & (following != _NONE)
        out[fill] = following[fill] + np.uint64(step << 32)
        empty &= ~fill
    return out


def _shortened(line: str, deletions: int) -> set[str]:
    """The line with at most so many characters left out."""
    found = last = {line}
    for _ in range(deletions):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        found = found | last
    return found


def bucket_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(position of a line, key) for all buckets of all lines."""
    where, keys = [], []
    for q, least, most in GRAMS:
        chosen = [k for k, x in enumerate(lines) if least <= len(x) <= most]
        if chosen:
            h, begin, counts = _grams([lines[k] for k in chosen], q)
            simhash, low = _simhash(h, begin, counts), _minhashes(h, begin, counts)
            own = [_mix((simhash & np.uint64(mask)) ^ np.uint64(_SALT * (64 * q + k) % 2**64)) for k, mask in enumerate(_MASKS)]
            for band in range(BANDS):
                key = np.full(len(low), 64 * q + 32 + band, np.uint64)
                for k in range(BAND):
                    key = _mix(key * np.uint64(31) + low[:, band * BAND + k])
                own.append(key)
            where.append(np.tile(np.array(chosen), len(own)))
            keys.append(np.concatenate(own))
    for k, line in enumerate(lines):
        if 0 < len(line) <= 4 * SHORT and (n := characters(line)) <= SHORT:
            longest = min(SHORT, int(n / SIMILARITY + 1e-9))
            short = [xxhash.xxh3_64_intdigest(x.encode()) for x in _shortened(line.decode(), int((1 - SIMILARITY) * longest + 1e-9))]
            where.append(np.full(len(short), k))
            keys.append(np.array(short, np.uint64))
    none = np.zeros(0, np.uint64)
    return np.concatenate([none.astype(np.int64), *where]), np.concatenate([none, *keys])


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edits / longer length reaches the similarity."""
    return distance(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9


class Lines:
    """Normalised lines with histograms of their characters: these bound the edits from below."""

    BINS, worth = 64, 12

    def __init__(self, lines):
        self.lines, self.words, self.sizes = lines, {}, np.array([len(x) for x in lines], int)
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sequences = np.split(codes, np.cumsum(self.sizes)[:-1])
        at = np.repeat(np.arange(len(lines)) * self.BINS, self.sizes)
        self.bins = np.bincount(at + codes % self.BINS, minlength=len(lines) * self.BINS).reshape(-1, self.BINS).astype(np.int32)

    @staticmethod
    def near(size_x, size_y):
        return np.minimum(size_x, size_y) >= SIMILARITY * np.maximum(size_x, size_y) - 1e-9

    @staticmethod
    def near_columns(size_x, size_y):
        return F.least(size_x, size_y) >= F.lit(SIMILARITY) * F.greatest(size_x, size_y) - F.lit(1e-9)

    @staticmethod
    def allowed(size_x, size_y):
        return ((1 - SIMILARITY) * np.maximum(size_x, size_y) + 1e-9).astype(np.int64)

    def least(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        # an edit changes the length or two characters' counts
        return (np.abs(self.bins[ys] - self.bins[xs]).sum(1, dtype=np.int64) + np.abs(self.sizes[ys] - self.sizes[xs])) // 2

    def at_most(self, x: int, y: int) -> int | None:
        for k in (x, y):
            if k not in self.words:
                self.words[k] = self.lines[k].split(" ")
        return some_alignment(self.words[x], self.words[y], int(self.allowed(self.sizes[x], self.sizes[y])))

    def measured(self, x: int, y: int) -> tuple[int, int]:
        most = self.at_most(x, y)
        return (0, most) if most is not None else (exact := distance(self.lines[x], self.lines[y]), exact)


def _doc_key(doc_id, text):
    """64 bits of a document; together with its id they name it."""
    return F.xxhash64(F.lit("doc"), doc_id, text)


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about AT_ONCE bytes, and the position of the first. Memory is given back after the last."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, "right")))
        yield begin, texts.slice(begin, end - begin).to_pylist()
        begin = end
    give_back()


def lines_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc, doc_id, line, id, check: one row per line with words; id and check are 128 bits of the normalised line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _parts(batch.column("text")):
                lines = [normalised(t) for t in texts]
                counts = np.array([len(x) for x in lines])
                lines = [x for of in lines for x in of]
                at = np.flatnonzero(np.array([len(x) for x in lines]))
                digest, line = digests([x for x in lines if x]), np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts)
                doc = pa.array(np.repeat(np.arange(begin, begin + len(counts)), counts)[at])
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(doc), batch.column("doc_id").take(doc), pa.array(line[at].astype(np.int32)), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["doc", "doc_id", "line", "id", "check"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(_doc_key(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id", "text").mapInArrow(run, f"doc long, doc_id {kind}, line int, id long, check long")


def _lines_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, value of the wanted lines. wanted: id, doc, doc_id, line."""
    texts = docs.select(_doc_key(F.col("doc_id"), F.col("text")).alias("doc"), "doc_id", "text")
    by_doc = wanted.groupBy("doc", F.col("doc_id").alias("_id")).agg(F.collect_list("id").alias("ids"), F.collect_list("line").alias("lines"), F.count("*").alias("n"))
    by_doc = materialize(by_doc.withColumnRenamed("doc", "_doc"), "wanted-lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _parts(batch.column("text")):
                ids, places = (batch.column(c).slice(begin, len(texts)) for c in ("ids", "lines"))
                found = []
                for text, at in zip(texts, places.to_pylist(), strict=True):
                    lines = _separated(text)
                    found += [b" ".join(lines[x].split()).decode() for x in at]
                yield pa.RecordBatch.from_arrays([ids.flatten(), pa.array(found, pa.string())], ["id", "value"])

    few = (by_doc.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_LINES
    same = (F.col("doc") == F.col("_doc")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    if not few:  # others need not be shuffled, as far as the list of these can be broadcast
        wanted_docs = by_doc.select(F.col("_doc").alias("_only")).distinct()
        texts = texts.join(F.broadcast(wanted_docs), texts["doc"] == wanted_docs["_only"], "left_semi") if wanted_docs.count() <= BROADCAST_IDS else texts
    return texts.join(F.broadcast(by_doc) if few else by_doc.hint("shuffle_hash"), same).select("text", "ids", "lines").mapInArrow(run, "id long, value string").dropDuplicates(["id"])


def members_of(docs: DataFrame) -> DataFrame:
    """key, id, size of the buckets of every line. A task sends a line once, however often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for _, texts in _parts(batch.column("text")):
                lines, new = [x for t in texts for x in normalised(t) if x], []
                ids, sent = digests(lines)[:, 0], set() if len(sent) > SENT else sent
                for k, x in enumerate(ids.tolist()):
                    if x not in sent:
                        sent.add(x)
                        new.append(k)
                lines = [lines[k] for k in new]
                sizes, (where, keys) = np.array([characters(x) for x in lines], np.int32), bucket_keys(lines)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[new][where]), pa.array(sizes[where])], ["key", "id", "size"])

    return docs.select("text").mapInArrow(run, "key long, id long, size int")


def _joined(rows: DataFrame, few: DataFrame, on: str, most: int, how: str = "inner") -> DataFrame:
    """By broadcast where `few` has at most so many rows, else by a shuffled join."""
    return rows.join(F.broadcast(few) if few.count() <= most else few, on, how)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The lines to remove as doc, doc_id, line."""
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found = materialize(lines_of(d), "lines")
    # a place of every line; where a line occurs more than once, its first place is looked for below
    sums = lambda t: materialize(t.groupBy("id").agg(F.count("*").alias("n"), F.min("check").alias("a"), F.max("check").alias("b"), *[F.first(c).alias(c) for c in ("doc", "doc_id", "line")]), "distinct-lines")
    lines, distinct = found, sums(found)
    clashes = distinct.where("a != b").select("id", "a")
    if not clashes.isEmpty():  # different lines that share 64 bits: one keeps its id, others get one that no bucket has
        lines = lines.join(clashes, "id", "left").withColumn("id", F.when(F.col("check") != F.col("a"), F.xxhash64(F.lit("other"), "check")).otherwise(F.col("id"))).drop("a")
        lines = materialize(lines, "lines")
        distinct = sums(lines)
    roots = link(members_of(d), lambda ids: _lines_with(d, only(distinct, ids, "id").select("id", "doc", "doc_id", "line")), Lines, once=True)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "doc", "line")
    firsts = materialize(only(lines, distinct.where("n > 1").select("id"), "id").groupBy("id").agg(F.min(place).alias("first")), "first-places")
    linked = _joined(distinct, roots, "id", BROADCAST_IDS).select("id", "root", place.alias("own"))
    linked = materialize(linked.join(firsts, "id", "left").select("id", "root", F.coalesce("first", "own").alias("first")), "linked-lines")
    moved = linked.join(linked.groupBy("root").agg(F.min("first").alias("best")), "root").select("id", "best")
    state = materialize(moved.unionByName(firsts.join(linked, "id", "left_anti").select("id", F.col("first").alias("best"))), "line-groups")
    extra = _joined(lines, state, "id", BROADCAST_LINES).where((F.col("doc") != F.col("best.doc")) | (F.col("line") != F.col("best.line")) | ~F.col("doc_id").eqNullSafe(F.col("best.doc_id")))
    extra = materialize(extra.select("doc", "doc_id", "line"), "repeated-lines")
    discard(found, lines, distinct, roots, firsts, linked, state)
    return extra


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated lines taken out of the text, and n_lines, n_removed. No row is dropped; a text may become empty.

    Lines end at line feeds. Blank lines and lines of punctuation stay. Null texts stay null and have no line. Rows that
    share id and text are the same document and are treated alike. Ids are of any type that can be ordered; null ids come last. Columns named
    n_lines and n_removed are replaced.
    """
    kept = docs.drop("n_lines", "n_removed")
    extra = marked(kept, id_col, text_col)
    by_doc = extra.groupBy("doc", F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("line")).alias("_gone")).withColumnRenamed("doc", "_doc")
    rows = kept.select(F.struct(*kept.columns).alias("_row"), _doc_key(F.col(id_col), text_of(text_col)).alias("doc"))
    same = (F.col("doc") == F.col("_doc")) & F.col("_row")[id_col].eqNullSafe(F.col("_id"))
    joined = rows.join(F.broadcast(by_doc) if extra.count() <= BROADCAST_LINES else by_doc.hint("shuffle_hash"), same, "left")
    old = F.col("_row")[text_col]
    left = F.array_join(F.filter(F.split(old, "\n", -1), lambda _, i: ~F.array_contains("_gone", i)), "\n")
    n = F.when(old.isNull(), F.lit(0)).otherwise(F.octet_length(old) - F.octet_length(F.replace(old, F.lit("\n"), F.lit(""))) + 1)
    return joined.select(*[(F.when(F.col("_gone").isNull(), old).otherwise(left) if c == text_col else F.col("_row")[c]).alias(c) for c in kept.columns], n.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(text_of("text"), "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {"op5_lines": op5_lines}
