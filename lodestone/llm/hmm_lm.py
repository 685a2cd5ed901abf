"""A hidden Markov language model, trained by Baum-Welch over all training texts.

Words are observed as symbols: each of the commonest words is one of its own, the end of a
text is one, and all other words fall into classes by their last two bytes. A word's
probability is that of its symbol under the hidden states times that of the word within its
class, from its count with one added. The count tables grow with the corpus and are joined,
never sent whole; only the ``MOST_SENT`` commonest words are broadcast.

Baum-Welch runs over all training texts in each round: every task adds up its expected
counts, which are summed across partitions by entry; the driver gets one number an entry, as
many as the model has. Texts are never cut: the forward pass remembers what it has reached
every ``RUN`` symbols, and the backward pass works from there, so that a text of any length
needs the memory of one run. Expected counts are added up as whole numbers of 1/65536, so the
model doesn't depend on the order of tasks. Scores come from the scaled forward recursion
over whole texts; they are sums of doubles, whose last digits may differ between runs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import keep

STATES = 8
#: Words with a symbol of their own, and classes of all other words.
OWN_SYMBOLS = 1500
CLASSES = 128
#: Commonest words whose counts are broadcast, at most; other words are joined.
MOST_SENT = 200_000
ROUNDS = 5
#: Symbols between two places that the forward pass remembers, and texts that step together.
RUN, TOGETHER = 64, 2000
#: Expected counts are added up in these parts of one.
_PARTS = 1 << 16
#: Words that a task counts before it passes the counts on.
FLUSH = 300_000
_SMOOTH = 0.1


def is_held_out(id_: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 7; rows without id are trained on."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the binary column ``text``; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "c"])
        for batch in batches:
            for text in batch.column(0):
                count.update(words_of(text.as_py()))
                if len(count) > FLUSH:
                    yield out()
                    count.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, most: int) -> list:
    """The rows of the ``most`` commonest words or fewer: those above the count at which they would be too many.

    The count is read off the number of words of each count, so no task sorts or holds all words.
    """
    left, least = most, 0
    for r in counts.groupBy("c").count().orderBy(F.desc("c")).limit(most).collect():
        if r["count"] > left:
            least = r.c
            break
        left -= r["count"]
    return sorted(counts.where(F.col("c") > least).collect(), key=lambda r: (-r.c, bytes(r.word)))


@dataclass
class Symbols:
    """Symbols of words, and what is known of the commonest words by number."""

    numbers: dict[bytes, int]
    counts: np.ndarray
    own: int
    class_counts: np.ndarray
    class_words: np.ndarray

    @property
    def size(self) -> int:
        return self.own + 1 + CLASSES

    @property
    def end(self) -> int:
        return self.own

    def of_words(self) -> np.ndarray:
        """The symbol of each numbered word."""
        return np.array([i if i < self.own else self.class_symbol(w) for w, i in self.numbers.items()], np.uint16)

    def class_symbol(self, word: bytes) -> int:
        return self.own + 1 + crc32(word[-2:]) % CLASSES

    def class_norm(self) -> np.ndarray:
        return np.log10(self.class_counts + self.class_words + 1.0)

    def within(self) -> np.ndarray:
        """log10 of the probability of each numbered word within its symbol."""
        out = np.log10(self.counts + 1.0)
        out[: self.own] = 0.0
        out[self.own :] -= self.class_norm()[self.of_words()[self.own :].astype(np.int64) - self.own - 1]
        return out


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, states: int, unigram: np.ndarray) -> Hmm:
        """A fixed start: the corpus's symbol counts, tilted otherwise for each state."""
        draw = np.random.default_rng(7)
        emit = (unigram + _SMOOTH) * draw.lognormal(0.0, 2.0, (states, len(unigram)))
        move = draw.uniform(0.5, 1.5, (states, states)) + states * np.eye(states)
        return cls(np.full(states, 1.0 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @property
    def shapes(self) -> list[tuple[int, ...]]:
        return [x.shape for x in (self.start, self.move, self.emit)]

    def updated(self, flat: np.ndarray) -> Hmm:
        parts, at = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            part = flat[at : at + n].reshape(shape) + _SMOOTH
            parts.append(part / part.sum(-1, keepdims=True))
            at += n
        return Hmm(*parts)

    def expected(self, texts: list[np.ndarray], run: int = RUN) -> np.ndarray:
        """Expected counts of starts, moves and emissions over whole texts, by scaled forward and backward passes.

        All texts step together, the longest first, so those that go on are a prefix. The
        forward pass keeps its state at the border of each run; the backward pass takes the
        runs from the last to the first and steps forward through each anew.
        """
        texts = sorted(texts, key=len, reverse=True)
        states, pad = len(self.start), self.emit.shape[1]
        lengths = np.array([len(x) for x in texts], np.int64)
        offsets, flat = np.cumsum(lengths) - lengths, np.concatenate(texts).astype(np.int64)
        emit = np.concatenate((self.emit.T, np.ones((1, states))))  # past its end a text shows a symbol that every state emits surely
        moves, emits = np.zeros((states, states)), np.zeros((pad, states))

        def symbols(at: int) -> np.ndarray:
            n, time = int((lengths > at).sum()), np.arange(at, min(at + run, int(lengths[0])))[:, None]
            return np.where(time < lengths[:n], flat[np.minimum(offsets[:n] + time, len(flat) - 1)], pad)

        def forward(seen: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            alpha, scale = np.empty_like(seen), np.empty((*seen.shape[:2], 1))
            for t in range(len(seen)):
                before = (self.start if before is None else before @ self.move) * seen[t]
                scale[t] = before.sum(1, keepdims=True)
                alpha[t] = before = before / scale[t]
            return alpha, scale

        borders: list[np.ndarray | None] = [None]
        for at in range(0, int(lengths[0]) - run, run):
            alpha, _ = forward(emit[symbols(at)], borders[-1])
            borders.append(alpha[-1][: int((lengths > at + run).sum())])
        beta = np.ones((0, states))
        for at in range((len(borders) - 1) * run, -1, -run):
            before, shown = borders.pop(), symbols(at)
            seen = emit[shown]
            alpha, scale = forward(seen, before)
            beta = np.concatenate((beta, np.ones((shown.shape[1] - len(beta), states))))
            gamma, ahead = np.empty_like(seen), np.empty_like(seen)  # ahead: what is to come, weighed by the emission, over the scale
            for t in range(len(seen) - 1, -1, -1):
                gamma[t] = alpha[t] * beta
                ahead[t] = seen[t] * beta / scale[t]
                beta = ahead[t] @ self.move.T
            inside = (shown != pad)[:, :, None]
            moves += alpha[:-1].reshape(-1, states).T @ (ahead * inside)[1:].reshape(-1, states)
            if before is not None:
                moves += before.T @ ahead[0]
            for k in range(states):
                emits[:, k] += np.bincount(shown.reshape(-1), gamma[:, :, k].reshape(-1), minlength=pad + 1)[:-1]
        return np.concatenate((gamma[0].sum(0), (self.move * moves).reshape(-1), emits.T.reshape(-1)))

    def log10_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probabilities of whole symbol sequences: all texts step together, the longest first."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        if not len(lengths):
            return out
        offsets = np.cumsum(lengths) - lengths
        flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # how many texts have a symbol at each step
        emit, total = np.ascontiguousarray(self.emit.T), np.zeros(len(texts))
        alpha = np.tile(self.start, (len(texts), 1))
        for t in range(int(lengths[0])):
            n = int(alive[t])
            alpha = (alpha[:n] @ self.move if t else alpha[:n]) * emit[flat[offsets[:n] + t]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[order] = total
        return out


def _symbols(counts: DataFrame) -> tuple[Symbols, int, int]:
    """The symbols from the word counts; the sum of counts and the number of words."""
    top = commonest(counts, MOST_SENT)
    own = min(OWN_SYMBOLS, len(top))
    least = (top[own - 1].c, bytes(top[own - 1].word)) if own else (0, b"")
    is_own = (F.col("c") > least[0]) | ((F.col("c") == least[0]) & (F.col("word") <= F.lit(bytearray(least[1])))) if own else F.lit(False)
    kind = (F.crc32(F.substring("word", -2, 2)) % CLASSES).alias("kind")
    classes = counts.groupBy(kind).agg(F.sum(F.when(is_own, 0).otherwise(F.col("c"))).alias("c"), F.count_if(~is_own).alias("v"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("words")).collect()
    sums, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes:
        sums[r.kind], words[r.kind] = r.c, r.v
    found = Symbols({bytes(r.word): i for i, r in enumerate(top)}, np.array([r.c for r in top], float), own, sums, words)
    return found, sum(r.n for r in classes), sum(r.words for r in classes)


def _observed(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """Each text as symbols, what the sent words add to its scores, and its other words with their counts."""
    sent = texts.sparkSession.sparkContext.broadcast(symbols)
    schema = "row long, id long, held_out boolean, n_words long, symbols binary, sent_counts double, sent_known long, sent_within double, others array<binary>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        of_words, logs, within = s.of_words(), np.log10(s.counts + 1.0), s.within()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(at, 1000), []
                for text in batch.column(3):
                    words = words_of(text.as_py())
                    numbers = np.fromiter(map(s.numbers.get, words, [-1] * len(words)), np.int64, len(words))
                    known = numbers >= 0
                    out = np.empty(len(words) + 1, np.uint16)
                    out[-1] = s.end
                    out[:-1][known] = of_words[numbers[known]]
                    rest = [words[i] for i in np.flatnonzero(~known).tolist()]
                    out[:-1][~known] = [s.class_symbol(w) for w in rest]
                    count = Counter(rest)
                    rows.append((len(words), out.tobytes(), float(logs[numbers[known]].sum()), int(known.sum()), float(within[numbers[known]].sum()), list(count.keys()), list(count.values())))
                columns = list(zip(*rows)) if rows else [[]] * 7
                kinds = (pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["row", "id", "held_out", "n_words", "symbols", "sent_counts", "sent_known", "sent_within", "others", "times"])

    return texts.select("row", "id", "held_out", "text").mapInArrow(run, schema)


def _round(observed: DataFrame, model: Hmm) -> Hmm:
    """One round of Baum-Welch over all training texts."""
    sent = observed.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = np.zeros(sum(int(np.prod(s)) for s in m.shapes))
        for batch in batches:
            texts = sorted((np.frombuffer(x, np.uint16) for x in batch.column(0).to_pylist()), key=len)
            for at in range(0, len(texts), TOGETHER):
                total += m.expected(texts[at : at + TOGETHER])
        parts = np.rint(total * _PARTS).astype(np.int64)
        at = np.flatnonzero(parts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(parts[at])], names=["entry", "n"])

    counts = observed.where("not held_out").select("symbols").mapInArrow(run, "entry int, n long").groupBy("entry").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(sum(int(np.prod(s)) for s in model.shapes))
    for r in counts:
        flat[r.entry] = r.n / _PARTS
    return model.updated(flat)


def _forward(observed: DataFrame, model: Hmm) -> DataFrame:
    sent = observed.sparkSession.sparkContext.broadcast(model)
    names = ["row", "id", "held_out", "n_words", "sent_counts", "sent_known", "sent_within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4000):
                batch = whole.slice(at, 4000)
                scores = sent.value.log10_likelihoods([np.frombuffer(x, np.uint16) for x in batch.column(7).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(scores)], names=[*names, "forward"])

    return observed.select(*names, "symbols").mapInArrow(run, "row long, id long, held_out boolean, n_words long, sent_counts double, sent_known long, sent_within double, forward double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    A-Z are lower-cased; tokens are runs without ASCII white space, then one end. Null texts
    count as empty: they have the end alone. Each row is scored, rows that repeat an id on
    their own; rows without id are trained on. ``base_score`` is the log10 probability under
    single words with one added to each count, ``score`` that under the model. Without any
    training row every token has probability one under the base.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = given.select(F.monotonically_increasing_id().alias("row"), "id", is_held_out(F.col("id")).alias("held_out"), "text")
    training = texts.where("not held_out")
    counts = keep(word_counts(training), "lm-counts")
    ends = training.count()
    symbols, total, words = _symbols(counts)
    n, v = total + ends, words + (ends > 0)
    observed = keep(_observed(texts, symbols), "lm-observed")
    unigram = np.zeros(symbols.size)
    np.add.at(unigram, symbols.of_words()[: symbols.own].astype(np.int64), symbols.counts[: symbols.own])
    unigram[symbols.end] = ends
    unigram[symbols.own + 1 :] = symbols.class_counts
    model = Hmm.first(states, unigram)
    for _ in range(rounds if ends else 0):
        model = _round(observed, model)
    norms = F.array(*[F.lit(float(x)) for x in symbols.class_norm()])
    others = observed.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select("row", F.col("o.others").alias("word"), F.col("o.times").alias("times"))
    met = others.join(counts, "word", "left").withColumn("log_c", F.log10(F.coalesce("c", F.lit(0)) + 1.0))
    norm = F.get(norms, (F.crc32(F.substring("word", -2, 2)) % CLASSES).cast("int"))
    rest = met.groupBy("row").agg(F.sum(F.col("times") * F.col("log_c")).alias("o_counts"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("o_known"), F.sum(F.col("times") * (F.col("log_c") - norm)).alias("o_within"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = _forward(observed, model).join(rest, "row", "left")
    return whole.select(
        F.col("id").alias(id_col),
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("sent_known") + F.coalesce("o_known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sent_counts") + zero("o_counts") + F.lit(float(np.log10(ends + 1.0))) - (F.col("n_words") + 1) * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"),
        (F.col("forward") + F.col("sent_within") + zero("o_within")).alias("score"),
    )
