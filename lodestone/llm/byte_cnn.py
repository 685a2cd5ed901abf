"""Text quality by a convolutional network over bytes, in numpy.

Every byte has a learned vector; filters of ``WIDTH`` bytes slide over the whole text. A text is
covered by overlapping chunks, each half a chunk after the one before; each filter's greatest
response in a chunk goes through a small hidden layer, and the means and maxima of the hidden
units over all chunks give one probability. A filter over a byte is a sum of table entries,
one for each place, so responses are looked up and added, not multiplied.

The network is trained in the driver on a bounded sample of labelled texts (``MOST_LABELLED``
rows by hash of the id, ``CHUNKS_SENT`` chunks of each at most, evenly spread, of which a step
draws ``MOST_CHUNKS``); equal texts with equal labels count once in it. Texts are scored whole, by tasks, in slabs, so
that a text of any length needs the memory of one slab besides its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.toxicity import labelled_sample

#: Labelled training rows, chunks of each that the driver gets, and chunks of a text in a step, all at most.
MOST_LABELLED, CHUNKS_SENT, MOST_CHUNKS = 4000, 40, 6
THRESHOLD = 0.7
EMBEDDED, WIDTH, FILTERS, HIDDEN = 6, 6, 24, 12
CHUNK = 256
HALF = CHUNK // 2
#: The symbol after a text's end.
PAD = 256
#: Steps of the fit at least, texts in a step, and the rate.
STEPS, TOGETHER, RATE = 900, 48, 0.01
#: Bytes whose responses are worked out at once.
SLAB = 1 << 15


@dataclass
class Network:
    bytes: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray

    @classmethod
    def first(cls, likely: float = 0.5) -> Network:
        """A fixed start. Byte vectors begin with what kind of byte it is: letter, capital, digit, white space, mark, none of ASCII."""
        draw = np.random.default_rng(11)
        kinds = [str.isalpha, str.isupper, str.isdigit, str.isspace, lambda c: not c.isalnum() and not c.isspace()]
        vectors = draw.normal(0, 0.1, (PAD + 1, EMBEDDED))
        for b in range(128):
            vectors[b, : len(kinds)] += [float(k(chr(b))) for k in kinds][:EMBEDDED]
        vectors[128:PAD, -1] += 1.0
        vectors[PAD] = 0
        scale = 1 / np.sqrt(EMBEDDED * WIDTH)
        return cls(
            vectors, draw.normal(0, 2 * scale, (WIDTH, EMBEDDED, FILTERS)), np.zeros(FILTERS), draw.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)),
            np.zeros(HIDDEN), draw.normal(0, 0.3, 2 * HIDDEN), np.array([np.log(likely / (1 - likely))]),
        )

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.bytes, self.filters, self.bias, self.inner, self.inner_bias, self.outer, self.outer_bias]

    def tables(self) -> np.ndarray:
        """[place][byte][filter]: what a byte adds to a filter's response."""
        return np.einsum("be,wef->wbf", self.bytes, self.filters).astype(np.float32)

    def probabilities(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """From the pooled responses of chunks, in texts that begin at ``starts``."""
        hidden = np.tanh(pooled @ self.inner + self.inner_bias)
        sizes = np.diff(np.append(starts, len(hidden)))[:, None]
        both = np.concatenate((np.add.reduceat(hidden, starts) / sizes, np.maximum.reduceat(hidden, starts)), 1)
        return 1 / (1 + np.exp(-np.clip(both @ self.outer + self.outer_bias[0], -30, 30)))


def responses(tables: np.ndarray, bias: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Responses at each place that has ``WIDTH`` symbols (last axis of ``symbols``), not below zero."""
    n = symbols.shape[-1] - WIDTH + 1
    out = tables[0].take(symbols[..., :n], axis=0)
    for w in range(1, WIDTH):
        out += tables[w].take(symbols[..., w : w + n], axis=0)
    out += bias.astype(np.float32)
    return np.maximum(out, 0, out=out)


def pooled(tables: np.ndarray, bias: np.ndarray, text: bytes) -> np.ndarray:
    """The greatest responses in each chunk of a whole text, padded to whole chunks; the empty text has one."""
    n, halves = CHUNK + max(0, -(-(len(text) - CHUNK) // HALF)) * HALF, []
    symbols = np.full(n + WIDTH - 1, PAD, np.uint16)
    symbols[: len(text)] = np.frombuffer(text, np.uint8)
    for i in range(0, n, SLAB):
        part = responses(tables, bias, symbols[i : min(i + SLAB, n) + WIDTH - 1])
        halves.append(np.maximum.reduceat(part, np.arange(0, len(part), HALF)))
    found = np.concatenate(halves)
    return np.maximum(found[:-1], found[1:])


# ---- the fit
def chunks_of(text: bytes, most: int = CHUNKS_SENT) -> np.ndarray:
    """Chunks of a text with the symbols that follow them, a row each: all, or ``most`` evenly spread."""
    starts = np.arange(0, max(1, len(text) - HALF), HALF)
    if len(starts) > most:
        starts = starts[np.linspace(0, len(starts) - 1, most).astype(int)]
    symbols = np.full(max(len(text), starts[-1] + CHUNK) + WIDTH - 1, PAD, np.uint16)
    symbols[: len(text)] = np.frombuffer(text, np.uint8)
    return symbols[starts[:, None] + np.arange(CHUNK + WIDTH - 1)]


def _gradients(net: Network, symbols: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss over texts that begin at ``starts`` of the chunks ``symbols``."""
    tables = net.tables()
    found = responses(tables, net.bias, symbols)
    at = found.argmax(1)
    best = np.take_along_axis(found, at[:, None, :], 1)[:, 0].astype(float)
    hidden = np.tanh(best @ net.inner + net.inner_bias)
    sizes = np.diff(np.append(starts, len(symbols)))
    of = np.repeat(np.arange(len(starts)), sizes)
    top = np.maximum.reduceat(hidden, starts)
    both = np.concatenate((np.add.reduceat(hidden, starts) / sizes[:, None], top), 1)
    p = 1 / (1 + np.exp(-np.clip(both @ net.outer + net.outer_bias[0], -30, 30)))
    d = (p - y) / len(y)
    d_both = d[:, None] * net.outer
    is_top = hidden == top[of]
    shared = np.add.reduceat(is_top.astype(float), starts)[of]
    d_hidden = d_both[of, :HIDDEN] / sizes[of][:, None] + is_top / shared * d_both[of, HIDDEN:]
    d_in = d_hidden * (1 - hidden**2)
    d_best = (d_in @ net.inner.T) * (best > 0)
    d_tables = np.empty((WIDTH, PAD + 1, FILTERS))
    columns, rows = np.arange(FILTERS), np.arange(len(symbols))[:, None]
    for w in range(WIDTH):
        place = symbols[rows, at + w].astype(np.int64) * FILTERS + columns
        d_tables[w] = np.bincount(place.ravel(), d_best.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
    d_bytes = np.einsum("wbf,wef->be", d_tables, net.filters)
    d_bytes[PAD] = 0
    return [d_bytes, np.einsum("be,wbf->wef", net.bytes, d_tables), d_best.sum(0), best.T @ d_in, d_in.sum(0), both.T @ d, np.array([d.sum()])]


def fit(texts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS) -> Network:
    """Adam with a falling rate and a little decay, over the chunks of texts in an order drawn anew in each epoch."""
    draw = np.random.default_rng(5)
    net = Network.first(float(np.clip(labels.mean(), 0.02, 0.98)))
    first, second = [np.zeros_like(x) for x in net.parts], [np.zeros_like(x) for x in net.parts]
    order: list[int] = []
    for step in range(1, steps + 1):
        while len(order) < TOGETHER:
            order += draw.permutation(len(texts)).tolist()
        some, order = order[:TOGETHER], order[TOGETHER:]
        chunks = [t if len(t) <= MOST_CHUNKS else t[np.sort(draw.choice(len(t), MOST_CHUNKS, replace=False))] for t in (texts[i] for i in some)]
        starts = np.cumsum([0, *(len(c) for c in chunks[:-1])])
        grads = _gradients(net, np.concatenate(chunks), starts, labels[some])
        rate = RATE * (1 - step / (steps + 1))
        for x, g, m, v in zip(net.parts, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-3 * x)
    return net


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Network:
    """The network from the labelled rows that aren't held out; nothing but texts and labels is read.

    Rows without label or id don't count; an id with several labels has the greatest, one with
    several texts the least. Without rows of both labels every text gets the share of label 1,
    or a half without any row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [chunks_of(t.as_py()).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), batch.column(1)], names=["chunks", "y"])

    sample = labelled_sample(docs, labels, id_col, text_col, label_col, most).select(F.col("text").cast("binary"), "y")
    rows = sorted((r.y, bytes(r.chunks)) for r in sample.mapInArrow(run, "chunks binary, y int").collect())
    y = np.array([r[0] for r in rows], float)
    if len(set(y)) < 2:
        net = Network.first(float(np.clip(y.mean(), 0.001, 0.999)) if len(y) else 0.5)
        net.outer[:] = 0
        return net
    return fit([np.frombuffer(r[1], np.uint16).reshape(-1, CHUNK + WIDTH - 1) for r in rows], y)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, chunks) for each row; null texts count as empty, which have one chunk of padding.

    Repeated rows and those without id are scored each; other columns aren't read. Whole texts
    are scored, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for batch in batches:
            found = [pooled(tables, sent.value.bias, t.as_py()) for t in batch.column(1)]
            if not found:
                continue
            sizes = np.array([len(f) for f in found])
            p = sent.value.probabilities(np.concatenate(found), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(sizes, pa.int64())], names=["id", "score", "chunks"])

    out = given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, score double, chunks long")
    return out.select(F.col("id").alias(id_col), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "chunks")
