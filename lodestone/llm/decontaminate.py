"""Benchmark decontamination by SimHash windows.

Every window of a document with as many words as a benchmark item gets a SimHash of its word
shingles. Multi-index blocks hold the items' fingerprints: a fingerprint within the radius
of another agrees with it up to ``radius // blocks`` bits in one block at least, so looking
up the ball of that radius in each block misses none. What is found is verified by the
complete distance and then by the exact weighted similarity of the shingles: the cosine of
their counts, which for windows of an item's size is the share of shingles in common.

A similarity of ``threshold`` needs common shingles, so only windows that hold at least one
shingle of the item are fingerprinted; all others have similarity zero. This leaves the
result as it would be with every window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.simhash import shingle_hashes, simhash

SHINGLE = 5
THRESHOLD = 0.8
#: At a cosine of 0.8 two 64-bit fingerprints differ in 13 bits on average, with a deviation of about 3.3.
RADIUS = 26
BLOCKS = 8
#: Benchmark items that may be broadcast; more are taken in parts of this size, with a scan each.
ITEMS_AT_ONCE = 20_000
#: Bytes of items that may be broadcast, but for a single longer one.
BYTES_AT_ONCE = 32 << 20

#: ASCII control characters and punctuation become spaces.
_SPACES = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation, so that case and punctuation don't hide a passage."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def cosine(a: Counter, b: Counter) -> float:
    dot = sum(n * b[x] for x, n in a.items())
    return dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5 if dot else 0.0


def ball(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits with ``radius`` ones at most."""
    every = np.arange(1 << width, dtype=np.uint64)
    return every[np.bitwise_count(every) <= radius].astype(np.int64)


class ItemIndex:
    """The items' shingles and the multi-index blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, radius: int, blocks: int) -> None:
        self.shingle, self.radius, self.blocks, self.width = shingle, radius, blocks, 64 // blocks
        known = [(i, w) for i, t in items if i is not None and (w := words_of(t))]
        self.ids = [i for i, _ in known]
        self.size = [len(w) for _, w in known]
        hashes = [shingle_hashes(w, shingle) for _, w in known]
        self.counts = [Counter(h.tolist()) for h in hashes]
        self.fps = np.array([simhash(h) for h in hashes], np.uint64)
        self.ball = ball(self.width, radius // blocks)
        # For each size of window, the items' fingerprints by block and value.
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for at, (size, fp) in enumerate(zip(self.size, self.fps.tolist())):
            for b, table in enumerate(self.tables.setdefault(size, [{} for _ in range(blocks)])):
                table.setdefault(fp >> (b * self.width) & ((1 << self.width) - 1), []).append(at)
        self.balls: dict[tuple[int, int, int], np.ndarray] = {}
        self.holders: dict[int, list[int]] = {}
        for at, count in enumerate(self.counts):
            for h in count:
                self.holders.setdefault(h, []).append(at)
        # Words numbered, and the items' runs of words as numbers, to pass over other text fast.
        self.vocabulary: dict[bytes, int] = {}
        grams = set()
        for _, w in known:
            codes = [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]
            k = min(shingle, len(codes))
            grams.update(tuple(codes[j : j + k]) for j in range(len(codes) - k + 1))
        self.lengths = sorted({len(g) for g in grams})
        self.grams = {k: np.unique(np.array([self._code(np.array([g]))[0] for g in grams if len(g) == k], np.uint64)) for k in self.lengths}

    @staticmethod
    def _code(columns: np.ndarray) -> np.ndarray:
        out = np.zeros(len(columns), np.uint64)
        for j in range(columns.shape[1]):
            out = out * np.uint64(0x9E3779B97F4A7C15) + columns[:, j].astype(np.uint64) + np.uint64(1)
        return out

    def anchors(self, words: list[bytes]) -> np.ndarray:
        """Places where a run of words that some item holds begins (and maybe, by a hash, others)."""
        codes = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        found = []
        for k in self.lengths:
            if len(words) < k:
                continue
            known = np.concatenate(([0], np.cumsum(codes >= 0)))
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if len(starts):
                at = np.searchsorted(self.grams[k], c := self._code(codes[starts[:, None] + np.arange(k)]))
                found.append(starts[self.grams[k][np.minimum(at, len(self.grams[k]) - 1)] == c])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def _in_ball(self, size: int, block: int, value: int) -> np.ndarray:
        """Items of a size whose block lies in the ball around the value; each ball is walked once."""
        key = (size, block, value)
        if key not in self.balls:
            table = self.tables[size][block]
            self.balls[key] = np.array([i for x in self.ball.tolist() for i in table.get(value ^ x, ())], np.int64)
        return self.balls[key]

    def candidates(self, fp: int, size: int) -> list[int]:
        """Items of a size within the radius of a fingerprint: the balls' matches, by complete distance."""
        mask = (1 << self.width) - 1
        seen = np.unique(np.concatenate([self._in_ball(size, b, fp >> (b * self.width) & mask) for b in range(self.blocks)]))
        return seen[np.bitwise_count(self.fps[seen] ^ np.uint64(fp)) <= self.radius].tolist()

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, number of words, distance, similarity): the best window of each item found."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        anchors = self.anchors(words)
        if not len(anchors):
            return []
        places: dict[int, set[int]] = {}
        for a in anchors.tolist():
            for k in self.lengths:
                if a + k > len(words):
                    continue
                h = int(shingle_hashes(words[a : a + k], k)[0])
                for item in self.holders.get(h, ()):
                    size = self.size[item]
                    places.setdefault(size, set()).update(range(max(0, a + min(self.shingle, size) - size), min(a, max(0, len(words) - size)) + 1))
        best: dict[int, tuple[float, int, int, int]] = {}
        for size, starts in places.items():
            low, high = min(starts), max(starts)
            k = min(self.shingle, size)
            hashes = shingle_hashes(words[low : high + size], k)
            n = size - k + 1
            for s in sorted(starts):
                window = hashes[s - low : s - low + n]
                fp = simhash(window)
                near = self.candidates(fp, size)
                if near:
                    count = Counter(window.tolist())
                    for i in near:
                        sim = cosine(count, self.counts[i])
                        if sim >= threshold and (i not in best or sim > best[i][0]):
                            best[i] = (sim, s, min(size, len(words)), (fp ^ int(self.fps[i])).bit_count())
        return [(self.ids[i], s, n, d, sim) for i, (sim, s, n, d) in sorted(best.items())]


def _parts(items: DataFrame, text_col: str, at_once: int) -> int:
    """Parts into which items are dealt, so that each has a bounded number and bounded bytes."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)).alias("bytes")).first()
    return max(1, -(-size.n // at_once), -(-size.bytes // BYTES_AT_ONCE))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS, blocks: int = BLOCKS, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(id, item_id, first_word, n_words, distance, similarity): each document and item with a window at ``threshold`` or more.

    The best window is given, the first of equals. Null or empty texts and items match nothing;
    items without id are left out. Rows that repeat a document give repeated rows. A document
    shorter than an item is held against it as one window. The items are sent to every task in parts of
    ``items_at_once`` and ``BYTES_AT_ONCE``, whatever their number.
    """
    parts = _parts(items, item_text, items_at_once)
    dealt = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null").withColumn("part", F.pmod(F.xxhash64("i"), F.lit(parts)))
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item_id long, first_word long, n_words long, distance int, similarity double"
    names = ["id", "item_id", "first_word", "n_words", "distance", "similarity"]
    out = None
    for part in range(parts):
        rows = [(r.i, r.t) for r in dealt.where(F.col("part") == part).distinct().collect()]
        sent = docs.sparkSession.sparkContext.broadcast(sorted(rows, key=lambda r: (r[0], r[1] or "")))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, shingle, radius, blocks)
            for batch in batches:
                found = [(i.as_py(), *m) for i, t in zip(batch.column(0), batch.column(1)) for m in index.matches(t.as_py(), threshold)]
                columns = list(zip(*found)) if found else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], names=names)

        found = given.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("id", id_col)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns.

    Rows are tested by their own text, those without id too, whatever the number of items:
    more than ``items_at_once`` are taken in parts, and the texts that hold an item of any
    part are named by their digest.
    """
    at_once, threshold = options.get("items_at_once", ITEMS_AT_ONCE), options.get("threshold", THRESHOLD)
    parts = _parts(items, options.get("item_text", "text"), at_once)
    given = items.select(F.col(options.get("item_col", "item_id")).cast("long").alias("i"), F.col(options.get("item_text", "text")).cast("string").alias("t")).where("i is not null")

    def tested(rows: DataFrame, part: int, at: int, wanted: bool) -> DataFrame:
        found = [(r.i, r.t) for r in given.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).distinct().collect()]
        sent = docs.sparkSession.sparkContext.broadcast(sorted(found, key=lambda r: (r[0], r[1] or "")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, options.get("shingle", SHINGLE), options.get("radius", RADIUS), options.get("blocks", BLOCKS))
            for batch in batches:
                yield batch.filter(pa.array([bool(index.matches(t.as_py(), threshold)) == wanted for t in batch.column(at)], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    if parts == 1:
        return tested(docs, 0, docs.columns.index(text_col), False)
    digest = F.sha2(F.col(text_col).cast("string").cast("binary"), 256)
    texts = docs.select(digest.alias("__held"), F.col(text_col).cast("string").alias("text"))
    held = None
    for part in range(parts):
        hit = tested(texts, part, 1, True).select("__held")
        held = hit if held is None else held.unionByName(hit)
    return docs.join(held.distinct(), digest == F.col("__held"), "left_anti").select(*docs.columns)
