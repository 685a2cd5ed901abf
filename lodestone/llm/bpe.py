"""Byte-level BPE: ranked merges folded by Spark's higher-order functions.

A text is cut into pieces by the tokenizer's pattern; each distinct piece of a block of texts
is merged once. The merges are a fold over the piece's array of byte tokens: at each step the
pair with the lowest rank, the leftmost of equals, becomes one token, until no pair has a
rank. Ranks are read from a literal map, a perfect hash of pairs held in two literal arrays,
so that a lookup takes two array accesses.

The pieces and the order in which they follow one another pass through a single stage: Python
numbers the pieces and sends each new one ahead of the texts, Spark folds the merges, and
Python puts the texts' ids together. Nothing is shuffled, and a task remembers ``BLOCK`` pieces
at most before it begins anew. Pieces of a sample of texts are merged beforehand and sent to
all tasks (``MOST_KNOWN`` at most); this saves merges and changes no result.

Encoded ids are a binary column of little-endian unsigned 32-bit integers. Decoding puts the
tokens' binary pieces together.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces that a task remembers at most besides the known ones.
BLOCK = 100_000
#: Pieces merged beforehand and sent to all tasks, at most, and texts that they are taken from, about.
MOST_KNOWN = 150_000
SAMPLE_TEXTS = 25_000
#: Pieces of more bytes are merged by a heap, since the fold takes time as the square of the length.
LONG_PIECE = 256
#: Pieces merged in one row, and texts in one batch that a task hands on.
CHUNK, PART = 500, 250

# Layout of an element of the fold's state: rank of the pair that it begins, its place, its token.
_TOKEN_BITS, _PLACE_BITS = 20, 20
_RANK_AT = _TOKEN_BITS + _PLACE_BITS
_TOKEN, _LOW = (1 << _TOKEN_BITS) - 1, (1 << _RANK_AT) - 1
_NO_RANK = 1 << 20
# Perfect hash: a pair's number times the factor gives a slot and the group whose shift is added.
_ID_BITS, _FACTORS = 17, range(331_804_471, 0, -2)
_SLOT_AT, _SLOT, _GROUP_AT, _GROUP = 24, (1 << 18) - 1, 42, (1 << 16) - 1
_EDGE = (1 << _ID_BITS) - 1  # a token that no pair has: it stands at both ends of the state
_LAST = (1 << _PLACE_BITS) - 1  # place of the edge at the end, so that both edges differ
_FREE = 1 << 62


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of byte strings, and the pattern that cuts text before the merges."""

    ranks: dict[bytes, int]
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def __getstate__(self) -> dict:
        """Tasks get the ranks alone; what they need else they work out."""
        return {"ranks": self.ranks, "pattern": self.pattern}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def _every_pair(self) -> Iterator[tuple[int, int, int]]:
        """Each pair of tokens that a token is made of, with its rank."""
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    yield left, right, rank

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        return {(left, right): rank for left, right, rank in self._every_pair()}

    @cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @cached_property
    def byte_pairs(self) -> np.ndarray:
        """The ranks of pairs of bytes, by both bytes."""
        out = np.full((256, 256), _NO_RANK, np.int64)
        for a in range(256):
            for b in range(256):
                out[a, b] = self.ranks.get(bytes((a, b)), _NO_RANK)
        return out

    @cached_property
    def hashed(self) -> tuple[int, np.ndarray, np.ndarray]:
        """(factor, shift of each group, pair and rank of each slot): the perfect hash of ``pairs``."""
        if max(self.ranks.values()) >= _EDGE:
            raise ValueError("too many tokens for the pairs' numbers")
        numbers, ranks = np.array([((left << _ID_BITS) + right, rank) for left, right, rank in self._every_pair()], np.int64).T
        factor = next(f for f in _FACTORS if len(np.unique(numbers * f >> _SLOT_AT & ((1 << 34) - 1))) == len(numbers))
        groups, slots = numbers * factor >> _GROUP_AT & _GROUP, numbers * factor >> _SLOT_AT & _SLOT
        sizes = np.bincount(groups, minlength=_GROUP + 1)
        order = np.lexsort((groups, -sizes[groups]))  # the largest groups choose their slots first
        slots, values = slots[order], (numbers << _TOKEN_BITS | ranks)[order]
        ends = np.cumsum(np.sort(sizes)[::-1])
        shifts, taken, at = np.zeros(_GROUP + 1, np.int64), bytearray(2 * (_SLOT + 1)), 0
        for end in ends[ends > np.r_[0, ends[:-1]]].tolist():
            own, shift = slots[at:end].tolist(), 0
            while any(taken[s + shift] for s in own):
                shift += 1
            shifts[groups[order[at]]] = shift
            for s in own:
                taken[s + shift] = 1
            at = end
        table = np.full(_SLOT + int(shifts.max()) + 2, _FREE, np.int64)
        table[slots + shifts[groups[order]]] = values
        return factor, shifts, table

    @cached_property
    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens on end, where each begins): the pieces that decoding joins."""
        names = sorted(self.ranks.items(), key=lambda x: x[1])
        starts = np.zeros(max(self.ranks.values()) + 2, np.int64)
        for token, rank in names:
            starts[rank + 1] = len(token)
        return np.frombuffer(b"".join(t for t, _ in names), np.uint8), np.cumsum(starts)

    def states(self, pieces: list[bytes]) -> pa.ListArray:
        """The fold's first state of each piece: the bytes' tokens with the ranks of their pairs, between two edges."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw, ends, number = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes), np.arange(len(pieces))
        rank = np.full(len(raw), _NO_RANK, np.int64)
        rank[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        rank[ends[sizes > 0] - 1] = _NO_RANK
        place = np.arange(len(raw)) - np.repeat(ends - sizes, sizes) + 1
        offsets = np.r_[0, ends + 2 * (number + 1)]
        out = np.full(len(raw) + 2 * len(pieces), _NO_RANK << _RANK_AT | _EDGE, np.int64)
        out[offsets[1:] - 1] |= _LAST << _TOKEN_BITS
        out[np.arange(len(raw)) + np.repeat(2 * number + 1, sizes)] = rank << _RANK_AT | place << _TOKEN_BITS | self.byte_ids[raw]
        return pa.ListArray.from_arrays(offsets.astype(np.int32), out)

    def merged_by_heap(self, piece: bytes) -> list[int]:
        """The ids of one long piece: the same merges in the same order, by a heap of pairs."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.pairs.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (r := self.pairs.get((rank, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[j]]))
            if before[i] >= 0 and (r := self.pairs.get((ids[before[i]], rank))) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [x for x in ids if x >= 0]


class Splitter:
    """Cuts a text into pieces. Latin text takes a plain pattern with the same classes spelled out."""

    def __init__(self, pattern: str) -> None:
        import regex

        self.full = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        spelled = lambda kind, below: "".join(rf"\u{c:04x}" for c in range(below) if regex.match(rf"\p{{{kind}}}", chr(c)))
        self.ascii, self.latin = (self._plain(pattern, *(spelled(k, n) for k in ("L", "N", "White_Space"))) for n in (0x80, 0x250))
        self.beyond = re.compile(r"[^\x00-ɏ]")

    @staticmethod
    def _plain(pattern: str, letters: str, numbers: str, spaces: str) -> re.Pattern:
        inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        return re.compile(inside.replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]"))

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text)
        return (self.full if self.beyond.search(text) else self.latin).findall(text)


def _literal(values: np.ndarray) -> Column:
    """A literal array, handed to the JVM as one block of longs.

    Written as text, which the optimizer can fold into the same literal, the rank map would
    stand with millions of characters in each description of a plan that the driver keeps.
    """
    from pyspark.sql.classic.column import Column as Classic

    context = SparkSession.active().sparkContext
    jvm = context._jvm
    held = context._gateway.new_array(jvm.long, len(values))
    jvm.java.nio.ByteBuffer.wrap(values.astype(">i8").tobytes()).asLongBuffer().get(held)
    types, catalyst = jvm.org.apache.spark.sql.types.DataTypes, jvm.org.apache.spark.sql.catalyst.expressions
    literal = catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(held), types.createArrayType(types.LongType, False))
    return Classic(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


def _let(value: Column, then) -> Column:
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_merges(state: Column, vocabulary: Vocabulary) -> Column:
    """The state (``Vocabulary.state``) after all merges: a fold of one merge a step."""
    factor, *arrays = vocabulary.hashed
    shifts, table = map(_literal, arrays)

    def rank(k: Column) -> Column:
        hashed = lambda h: F.get(table, (F.get(shifts, F.shiftright(h, _GROUP_AT).bitwiseAND(_GROUP).cast("int")) + F.shiftright(h, _SLOT_AT).bitwiseAND(_SLOT)).cast("int"))
        return F.least(_let(k * factor, hashed).bitwiseXOR(F.shiftleft(k, _TOKEN_BITS)), F.lit(_NO_RANK).cast("long"))

    token = lambda e: e.bitwiseAND(_TOKEN)

    def merge(s: Column, m: Column, p: Column) -> Column:
        new, before = F.shiftright(m, _RANK_AT), F.get(s, p - 2)
        left = F.shiftleft(rank(F.shiftleft(token(before), _ID_BITS) + new), _RANK_AT) + before.bitwiseAND(_LOW)
        right = F.shiftleft(rank(F.shiftleft(new, _ID_BITS) + token(F.get(s, p + 1))), _RANK_AT) + m.bitwiseAND(_LOW - _TOKEN) + new
        rest = F.array_remove(F.array_remove(F.array_remove(s, F.get(s, p)), m), before)
        return F.array_insert(F.array_insert(rest, p - 1, right), p - 1, left)

    def step(s: Column, _: Column) -> Column:
        return _let(F.array_min(s), lambda m: F.when(m >= _NO_RANK << _RANK_AT, s).otherwise(_let(F.array_position(s, m).cast("int"), lambda p: merge(s, m, p))))

    return F.aggregate(F.sequence(F.lit(4), F.size(state)), state, step)


_PIECES, _TEXT, _ANEW, _LONG = range(4)
_ROW = "kind int, id long, data binary, states array<array<bigint>>"


class _Numbers(dict):
    """Numbers of pieces in the order in which they come up."""

    def __init__(self, known: list[str]) -> None:
        super().__init__(zip(known, range(len(known))))
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class _Rows:
    """Rows of ``_ROW`` for one batch; states stand in it piece by piece."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.held: list[bytes] = []
        self.ends = [0]

    def add(self, kind: int, id_: int | None = None, data: bytes | None = None) -> None:
        self.rows.append((kind, id_, data))
        self.ends.append(len(self.held))

    def pieces(self, pieces: list[bytes]) -> None:
        for at in range(0, len(pieces), CHUNK):
            self.held += pieces[at : at + CHUNK]
            self.add(_PIECES)

    def batch(self, vocabulary: Vocabulary) -> pa.RecordBatch:
        kinds, ids, data = zip(*self.rows)
        states = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), vocabulary.states(self.held))
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(ids, pa.int64()), pa.array(data, pa.binary()), states], names=["kind", "id", "data", "states"])


def _numbered(vocabulary: Vocabulary, known: list[str]):
    """Texts to rows: states of new pieces ahead of the texts as numbers of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(vocabulary.pattern)
        numbers = _Numbers(known)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part, texts, rows = batch.slice(at, PART), [], _Rows()
                for id_, text in zip(part.column(0), part.column(1)):
                    found = split(text.as_py() or "")
                    texts.append((id_.as_py(), np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)).tobytes()))
                held: list[bytes] = []
                for piece in map(str.encode, numbers.new):
                    if len(piece) <= LONG_PIECE:
                        held.append(piece)
                        continue
                    rows.pieces(held)
                    held = []
                    rows.add(_LONG, data=np.array(vocabulary.merged_by_heap(piece), np.uint32).tobytes())
                rows.pieces(held)
                numbers.new = []
                for id_, data in texts:
                    rows.add(_TEXT, id_, data)
                if len(numbers) - len(known) > BLOCK:
                    numbers = _Numbers(known)
                    rows.add(_ANEW)
                yield rows.batch(vocabulary)

    return run


def _ids_of(states: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids on end, how many each piece has) of folded states (a list for each piece), without their edges."""
    flat = states.values.to_numpy(zero_copy_only=False)
    offsets = states.offsets.to_numpy()
    flat, offsets = flat[offsets[0] : offsets[-1]], offsets - offsets[0]
    inner = np.ones(len(flat), bool)
    inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
    return (flat[inner] & _TOKEN).astype(np.uint32), np.diff(offsets) - 2


class _Pieces:
    """Ids of numbered pieces, kept on end; grows by parts."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.first = ids, sizes
        self.anew()

    def anew(self) -> None:
        self.ids, self.sizes = [self.first[0]], [self.first[1]]
        self.joined: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.joined = None

    def text(self, numbers: np.ndarray) -> np.ndarray:
        if self.joined is None:
            sizes = np.concatenate(self.sizes)
            self.joined = np.concatenate(self.ids), np.cumsum(sizes) - sizes, sizes
            self.ids, self.sizes = [self.joined[0]], [sizes]
        ids, starts, sizes = self.joined
        return gather(ids, starts[numbers], sizes[numbers])


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, on end."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _decoded(data: bytes, raw: np.ndarray, starts: np.ndarray) -> bytes:
    """The tokens' binary pieces of little-endian ids, put together."""
    ids = np.frombuffer(data, "<u4")
    return gather(raw, starts[ids], np.diff(starts)[ids]).tobytes()


def _joined(known_ids: np.ndarray, known_sizes: np.ndarray, tokens: tuple[np.ndarray, np.ndarray] | None = None):
    """Rows with folded states to (id, ids), and what the ids decode to if ``tokens`` are given."""
    names = ["id", "ids", "decoded"][: 3 if tokens else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces(known_ids, known_sizes)
        for batch in batches:
            ids, out = [], []

            def made() -> pa.RecordBatch:
                columns = [pa.array(ids, pa.int64()), pa.array(out, pa.binary())]
                return pa.RecordBatch.from_arrays(columns + ([pa.array([_decoded(x, *tokens) for x in out], pa.binary())] if tokens else []), names=names)

            states = batch.column(3)
            for at, kind in enumerate(batch.column(0).to_pylist()):
                if kind == _PIECES:
                    pieces.add(*_ids_of(states[at].values))
                elif kind == _LONG:
                    data = np.frombuffer(batch.column(2)[at].as_py(), np.uint32)
                    pieces.add(data, np.array([len(data)]))
                elif kind == _ANEW:
                    pieces.anew()
                else:
                    ids.append(batch.column(1)[at].as_py())
                    out.append(pieces.text(np.frombuffer(batch.column(2)[at].as_py(), np.int32)).astype("<u4").tobytes())
                    if len(ids) == PART:
                        yield made()
                        ids, out = [], []
            if ids:
                yield made()

    return run


def _folded(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    return rows.select("kind", "id", "data", F.transform("states", lambda s: fold_merges(s, vocabulary)).alias("states"))


def known_pieces(texts: DataFrame, vocabulary: Vocabulary, most: int = MOST_KNOWN, sample: int = SAMPLE_TEXTS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The commonest pieces of a sample of texts with their ids: a bounded table that saves merges."""
    parts = texts.count() // sample
    if parts < 2:  # a sample would be all texts: each task merges its own
        return [], np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, count = Splitter(vocabulary.pattern), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], names=["piece", "n"])
        for batch in batches:
            for text in batch.column(0):
                count.update(p for p in split(text.as_py() or "") if len(p) <= LONG_PIECE // 4)
            if len(count) > BLOCK:
                yield out()
                count.clear()
        yield out()

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).select("text")
    counted = some.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "piece").limit(most).select("piece")

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.column(0).slice(at, CHUNK)
                whole = pa.array([0, len(some)], pa.int32())
                held = vocabulary.states([p.as_py().encode() for p in some])
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole, some), pa.ListArray.from_arrays(whole, held)], names=["pieces", "states"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces, state in zip(batch.column(0), batch.column(1)):
                ids, sizes = _ids_of(state.values)
                yield pa.RecordBatch.from_arrays([pa.array([pieces.as_py()], pa.list_(pa.string())), pa.array([ids.tobytes()]), pa.array([sizes.astype(np.int64).tobytes()])], names=["pieces", "ids", "sizes"])

    rows = top.repartition(max(8, texts.sparkSession.sparkContext.defaultParallelism), F.xxhash64("piece")).mapInArrow(states, "pieces array<string>, states array<array<bigint>>")
    rows = rows.select("pieces", F.transform("states", lambda s: fold_merges(s, vocabulary)).alias("states"))
    got = rows.mapInArrow(packed, "pieces array<string>, ids binary, sizes binary").collect()
    ids, sizes = (np.frombuffer(b"".join(bytes(r[c]) for r in got), kind) for c, kind in (("ids", np.uint32), ("sizes", np.int64)))
    return [p for r in got for p in r.pieces], ids, sizes


class _Sent:
    """A function made on the executors from a broadcast value."""

    def __init__(self, sent, make) -> None:
        self.sent, self.make = sent, make

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return self.make(*self.sent.value)(batches)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids, n_tokens): the ids of each whole text, without special tokens.

    A null text counts as empty and has no ids. One row is made for each row given, null and
    repeated ids included; an empty table gives none. Only the two named columns are read.
    With ``decoded`` there is a column of that name with what ``decode`` makes of the ids,
    worked out where they are put together.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    known, ids, sizes = known_pieces(texts, vocabulary)
    first = _Sent(context.broadcast((vocabulary, known)), _numbered)
    last = _Sent(context.broadcast((ids, sizes, vocabulary.tokens if decoded else None)), _joined)
    encoded = _folded(texts.mapInArrow(first, _ROW), vocabulary).mapInArrow(last, "id long, ids binary" + (", decoded binary" if decoded else ""))
    return encoded.select(F.col("id").alias(id_col), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *(["decoded"] if decoded else []))


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for: their tokens' pieces, put together. Null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in [*encoded.dtypes, (out_col, "binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PART):
                batch = whole.slice(first, PART)
                texts = [None if x is None else _decoded(x, *sent.value) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, schema)
