"""Importance resampling towards a target distribution.

Words are hashed into buckets; a bucket's gain is the logarithm of how much likelier it is in
the target texts than in the corpus, and a document's weight is the sum of the gains of its
features, looked up in one array. With Gumbel noise from a hash of its id added, the highest
scores are a draw without replacement in proportion to the weights.

The draw is an external sort that stops early. Each task sorts the keys of its eligible
documents into runs, stored in blocks. Keys at even places of the runs give splitters, and
counting the keys between them says where the draw ends; blocks are cut at the splitters, and
only the pieces of ranges that the draw needs are shuffled. A task merges the runs of a range
by a tournament tree: blocks arrive by their first key, and one is opened when that key is
next, so memory holds a block of each run. Ranks follow from the sizes of the ranges before.
Keys end with a row number, so equal scores and repeated ids split over ranges as well.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import keep

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
#: Keys in a block, and in a sorted run.
BLOCK, RUN = 256, 1_000_000
#: Keys that a range should have, and keys sampled for the splitters at most (of blocks taken by hash).
RANGE, SAMPLE = 100_000, 20_000
#: Features that a task remembers with their bucket before it begins anew.
MEMO = 400_000

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_COLUMNS = ["doc_id", "n_features", "weight", "score", "row"]
_RUNS = "block long, n int, " + ", ".join(f"{c}s array<long>" for c in _COLUMNS)
Key = tuple[int, int, int]


class _Buckets(dict):
    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[feature] = out = crc32(feature) % BUCKETS
        return out


def features(text: bytes | None, longest: int = 1) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space, repeats included."""
    words = _WORDS.findall((text or b"").lower())
    return words + [b" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1)]


def bucket_counts(texts: DataFrame, text_col: str, longest: int = 1) -> np.ndarray:
    """How many features of all texts fall into each bucket; each task adds up an array first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, bucket = np.zeros(BUCKETS, np.int64), _Buckets()
        for batch in batches:
            for text in batch.column(0):
                found = features(text.as_py(), longest)
                count += np.bincount(np.fromiter(map(bucket.__getitem__, found), np.int64, len(found)), minlength=BUCKETS)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select(F.col(text_col).cast("string").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, n_words of each row; the score is null without id."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets()
        for batch in batches:
            ids, sizes, weights, words = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1):
                found = features(text.as_py(), longest)
                weights.append(int(sent.value[np.fromiter(map(bucket.__getitem__, found), np.int64, len(found))].sum()))
                sizes.append(len(found))
                words.append(len(found) if longest == 1 else len(features(text.as_py())))
            scores = [None if i is None else w + noise(i, seed) for i, w in zip(ids, weights)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, sizes, weights, scores, words)], names=["doc_id", "n_features", "weight", "score", "n_words"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, "doc_id long, n_features long, weight long, score long, n_words long")


# ---- sorted runs
def _blocks(table: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
    columns = [table.column(c).to_numpy() for c in _COLUMNS]
    order = np.lexsort((columns[4], columns[0], -columns[3]))
    columns = [c[order] for c in columns]
    for i in range(0, len(order), BLOCK):
        part = [c[i : i + BLOCK] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array([number + i // BLOCK], pa.int64()), pa.array([len(part[0])], pa.int32()), *(pa.array([c]) for c in part)], names=["block", "n", *(f"{c}s" for c in _COLUMNS)])


def _runs(eligible: DataFrame) -> DataFrame:
    """Each partition's rows as sorted runs in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n, number = [], 0, 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= RUN:
                yield from _blocks(pa.Table.from_batches(waiting), number)
                waiting, number, n = [], number + n // BLOCK + 1, 0
        if n:
            yield from _blocks(pa.Table.from_batches(waiting), number)

    return eligible.select(*_COLUMNS).mapInArrow(run, _RUNS)


def _splitters(runs: DataFrame, blocks: int, ranges: int) -> list[Key]:
    """Keys that divide the runs into ranges of about the same size."""
    each = 16
    some = runs.where(F.pmod(F.xxhash64("block", F.col("rows")[0]), F.lit(max(1, math.ceil(blocks * each / SAMPLE)))) == 0)
    places = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.greatest(F.lit(1), F.floor(F.col("n") / each).cast("int"))))
    found = sorted((-r[0], r[1], r[2]) for r in some.select("scores", "doc_ids", "rows", places.alias("i")).selectExpr("scores[i]", "doc_ids[i]", "rows[i]").collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


class _Block:
    """A sorted block's columns, and how far it has been read."""

    def __init__(self, columns: list[np.ndarray]) -> None:
        self.columns, self.at, self.n = columns, 0, len(columns[0])

    def key(self, i: int) -> Key:
        return -int(self.columns[3][i]), int(self.columns[0][i]), int(self.columns[4][i])

    def place(self, key: Key, start: int = 0) -> int:
        """The first place from ``start`` on whose key isn't before ``key``."""
        return bisect_left(range(self.n), key, start, key=self.key)


def _cut(block: _Block, splitters: list[Key]) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of the pieces of a block."""
    at, r = 0, bisect_left(splitters, block.key(0))
    r += r < len(splitters) and splitters[r] == block.key(0)
    while at < block.n:
        to = block.place(splitters[r], at) if r < len(splitters) else block.n
        if to > at:
            yield r, at, to
        at, r = to, r + 1


def _columns_of(batch: pa.RecordBatch) -> Iterator[list[np.ndarray]]:
    lists = [batch.column(f"{c}s") for c in _COLUMNS]
    for i in range(batch.num_rows):
        yield [x[i].values.to_numpy() for x in lists]


def _range_sizes(runs: DataFrame, splitters: list[Key]) -> list[int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(splitters) + 1, np.int64)
        for batch in batches:
            for columns in _columns_of(batch):
                for r, start, to in _cut(_Block(columns), splitters):
                    count[r] += to - start
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count))), pa.array(count)], names=["range", "n"])

    out = [0] * (len(splitters) + 1)
    for x in runs.mapInArrow(run, "range long, n long").groupBy("range").agg(F.sum("n").alias("n")).collect():
        out[x.range] = x.n
    return out


def _pieces(runs: DataFrame, splitters: list[Key], last: int) -> DataFrame:
    """The blocks cut at the splitters, up to the range ``last``, with their first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4 + len(_COLUMNS))]
            for columns in _columns_of(batch):
                block = _Block(columns)
                for r, start, to in _cut(block, splitters):
                    if r <= last:
                        for to_column, value in zip(out, (r, *block.key(start), *(c[start:to] for c in columns))):
                            to_column.append(value)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in out[4:]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:4]), *lists], names=["range", "k1", "k2", "k3", *(f"{c}s" for c in _COLUMNS)])

    return runs.mapInArrow(run, "range long, k1 long, k2 long, k3 long, " + ", ".join(f"{c}s array<long>" for c in _COLUMNS))


# ---- merging
class Tournament:
    """A tree of matches over the heads of open blocks: ``tree[1]`` is the winner's leaf, the least key."""

    def __init__(self) -> None:
        self.size, self.keys, self.tree, self.free = 1, [None], [0, 0], [0]

    def _better(self, a: int, b: int) -> int:
        return b if self.keys[a] is None or (self.keys[b] is not None and self.keys[b] < self.keys[a]) else a

    def put(self, leaf: int, key: Key | None) -> None:
        """Give a leaf another key (None: nothing left) and play its matches again."""
        self.keys[leaf] = key
        node = (leaf + self.size) // 2
        while node:
            self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
            node //= 2

    def enter(self, key: Key) -> int:
        """A free leaf for another block; the tree doubles when none is left."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.keys += [None] * self.size
            self.size *= 2
            self.tree = [0] * self.size + list(range(self.size))
            for node in range(self.size - 1, 0, -1):
                self.tree[node] = self._better(self.tree[2 * node], self.tree[2 * node + 1])
        leaf = self.free.pop()
        self.put(leaf, key)
        return leaf

    @property
    def winner(self) -> int | None:
        leaf = self.tree[1]
        return None if self.keys[leaf] is None else leaf

    def runner_up(self) -> Key | None:
        """The least key but the winner's: the best of those that lost to it."""
        node, out = self.tree[1] + self.size, None
        while node > 1:
            key = self.keys[self.tree[node ^ 1]]
            if key is not None and (out is None or key < out):
                out = key
            node //= 2
        return out

    def leave(self, leaf: int) -> None:
        self.put(leaf, None)
        self.free.append(leaf)


def merged(blocks: Iterable[_Block], most: int) -> Iterator[list[np.ndarray]]:
    """The first ``most`` entries of sorted blocks that arrive by their first key, as slices of columns."""
    tree, opened, arriving = Tournament(), {}, iter(blocks)
    waiting = next(arriving, None)
    while most > 0:
        leaf = tree.winner
        if waiting is not None and (leaf is None or waiting.key(0) < tree.keys[leaf]):
            opened[tree.enter(waiting.key(0))] = waiting
            waiting = next(arriving, None)
            continue
        if leaf is None:
            return
        block, until = opened[leaf], tree.runner_up()
        if waiting is not None and (until is None or waiting.key(0) < until):
            until = waiting.key(0)
        to = block.n if until is None else max(block.at + 1, block.place(until, block.at))
        to = min(to, block.at + most)
        yield [c[block.at : to] for c in block.columns]
        most -= to - block.at
        block.at = to
        if to < block.n:
            tree.put(leaf, block.key(to))
        else:
            del opened[leaf]
            tree.leave(leaf)


def _ranked(pieces: DataFrame, before: list[int], draw: int) -> DataFrame:
    """The drawn rows with their ranks; a task merges the runs of its ranges one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r, columns) for batch in batches for r, columns in zip(batch.column("range").to_pylist(), _columns_of(batch)))
        ahead = next(rows, None)

        def of_range(r: int) -> Iterator[_Block]:
            nonlocal ahead
            while ahead is not None and ahead[0] == r:
                block, ahead = _Block(ahead[1]), next(rows, None)
                yield block

        while ahead is not None:
            r = ahead[0]
            rank, blocks = before[r], of_range(r)
            waiting: list[list[np.ndarray]] = []
            for part in merged(blocks, draw - rank):
                waiting.append(part)
                if len(waiting) >= 1000:
                    yield _with_ranks(waiting, rank)
                    rank += sum(len(p[0]) for p in waiting)
                    waiting = []
            if waiting:
                yield _with_ranks(waiting, rank)
            for _ in blocks:  # what lies after the draw's end
                pass

    split = pieces.repartition(len(before), "range").sortWithinPartitions("range", "k1", "k2", "k3")
    return split.select("range", *(f"{c}s" for c in _COLUMNS)).mapInArrow(run, ", ".join(f"{c} long" for c in [*_COLUMNS, "rank"]))


def _with_ranks(parts: list[list[np.ndarray]], before: int) -> pa.RecordBatch:
    columns = [np.concatenate([p[i] for p in parts]) for i in range(len(_COLUMNS))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.arange(before + 1, before + 1 + len(columns[0])))], names=[*_COLUMNS, "rank"])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least: int = LEAST_WORDS, longest: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of ``docs``; rows that aren't drawn have no rank.

    floor(percent * N / 100) rows are drawn, N being those with ``least`` words and an id. Null
    and empty texts have no feature and weigh nothing. Rows without id have no score and aren't
    drawn. Repeated rows count and are drawn each; equal scores go by id, then by row. Whole
    texts are read; other columns than the id and the text aren't. An empty target gives gains
    against nothing, an empty corpus an empty result.
    """
    gain = gains(bucket_counts(docs, text_col, longest), bucket_counts(target, target_col, longest))
    rows = keep(scored(docs, gain, id_col, text_col, longest, seed).withColumn("row", F.monotonically_increasing_id()), "resample-scored")
    can = F.col("score").isNotNull() & (F.col("n_words") >= least)
    runs = keep(_runs(rows.where(can)), "resample-runs")
    size = runs.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    draw = percent * size.n // 100
    undrawn = lambda df: df.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if draw <= 0:
        return undrawn(rows)
    splitters = _splitters(runs, size.blocks, max(docs.sparkSession.sparkContext.defaultParallelism * 4, math.ceil(size.n / RANGE)))
    sizes = _range_sizes(runs, splitters)
    before = [0, *np.cumsum(sizes).tolist()]
    last = bisect_left(before, draw) - 1
    drawn = keep(_ranked(_pieces(runs, splitters, last), before[: last + 1], draw), "resample-drawn")
    end = drawn.where(F.col("rank") == draw).first()
    after = (F.col("score") < end.score) | ((F.col("score") == end.score) & ((F.col("doc_id") > end.doc_id) | ((F.col("doc_id") == end.doc_id) & (F.col("row") > end.row))))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").unionByName(undrawn(rows.where(~F.coalesce(can & ~after, F.lit(False)))))


RESAMPLE_SQL = rf"""WITH bits AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
a AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
aw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM a) GROUP BY w), bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(words) AS w FROM b) GROUP BY w),
k AS (SELECT w, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM (SELECT w, hex(w) AS h FROM (SELECT w FROM aw UNION SELECT w FROM bw)), bits),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM aw JOIN k USING (w) GROUP BY bucket), t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0)::BIGINT FROM s) + {BUCKETS}))::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0)::BIGINT FROM t) + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
v AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(words) AS w FROM a) JOIN k USING (w) JOIN g USING (bucket) GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(len(words), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('{SEED}:' || doc_id), 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score FROM a LEFT JOIN v USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT {PERCENT} * count(*) // 100 FROM d WHERE n_features >= {LEAST_WORDS}) THEN place END AS rank FROM r"""
