"""The byte network against plain convolutions, numeric gradients and held-out labels."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lodestone.llm import byte_cnn, registry

DATA = "/root/testdata/sf0.01"


def plain(net: byte_cnn.Network, text: bytes) -> float:
    """One text by the definition: each chunk, each filter, each place."""
    symbols = [*text, *[byte_cnn.PAD] * (byte_cnn.CHUNK + byte_cnn.WIDTH)]
    hidden = []
    for start in range(0, max(1, len(text) - byte_cnn.HALF), byte_cnn.HALF):
        best = np.zeros(byte_cnn.FILTERS)
        for i in range(start, start + byte_cnn.CHUNK):
            value = net.bias + sum(net.bytes[symbols[i + w]] @ net.filters[w] for w in range(byte_cnn.WIDTH))
            best = np.maximum(best, value)
        hidden.append(np.tanh(best @ net.inner + net.inner_bias))
    both = np.concatenate((np.mean(hidden, 0), np.max(hidden, 0)))
    return float(1 / (1 + np.exp(-(both @ net.outer + net.outer_bias[0]))))


def test_scores_are_plain_convolutions(spark):
    """Null, empty, short, one over a chunk, one over a slab, no id, repeated, clashing columns."""
    net = byte_cnn.Network.first(0.6)
    net.bias += 0.1
    texts = [None, "", "a", "Ab " * 50, "x" * 257, "Ünï " * 120, "word! " * 7000]
    rows = [(i, t, 0.5, "p") for i, t in enumerate(texts)] + [(None, "no id", 0.5, "p"), (3, "Ab " * 50, 0.5, "p")]
    got = byte_cnn.score(spark.createDataFrame(rows, "doc_id long, text string, score double, predicted string"), net).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id != 6:
            assert r.score == pytest.approx(plain(net, ("no id" if r.doc_id is None else texts[r.doc_id] or "").encode()), abs=1e-5)
        assert r.predicted == int(r.score >= 0.7)
    assert {r.doc_id: r.chunks for r in got}[6] == -(-42000 // byte_cnn.HALF) - 1
    long = ("word! " * 7000).encode()
    assert {r.doc_id: r.score for r in got}[6] == pytest.approx(plain(net, long[:1500]), abs=1e-2)


def test_gradients():
    net = byte_cnn.Network.first()
    draw = np.random.default_rng(2)
    net.outer += draw.normal(0, 0.5, net.outer.shape)
    net.bias += draw.uniform(0.05, 0.2, net.bias.shape)  # off the kink of the empty text
    chunks = [byte_cnn.chunks_of(t) for t in (b"Some words here. " * 40, b"", b"SHOUT!! " * 30)]
    symbols, starts, y = np.concatenate(chunks), np.cumsum([0, *(len(c) for c in chunks[:-1])]), np.array([1.0, 0.0, 0.0])

    def loss() -> float:
        p = net.probabilities(byte_cnn.responses(net.tables(), net.bias, symbols).max(1).astype(float), starts)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for part, grad in zip(net.parts, byte_cnn._gradients(net, symbols, starts, y)):
        for i in draw.choice(part.size, min(4, part.size), replace=False):
            at = np.unravel_index(i, part.shape)
            was, step = part[at], 2e-4
            if part is net.bytes and at[0] == byte_cnn.PAD:
                continue
            part[at] = was + step
            up = loss()
            part[at] = was - step
            assert grad[at] == pytest.approx((up - loss()) / (2 * step), abs=2e-3)
            part[at] = was


def test_held_out_quality(spark):
    got = registry.QUERIES["op12_quality_classifier"](spark, DATA)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert np.mean([p for y, p in held if y == 1]) > 0.93 and np.mean([1 - p for y, p in held if y == 0]) > 0.85


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in byte_cnn.score(docs, byte_cnn.train(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in byte_cnn.score(docs, byte_cnn.train(docs, one)).collect())
    assert byte_cnn.score(docs.limit(0), byte_cnn.train(docs.limit(0), none)).count() == 0
