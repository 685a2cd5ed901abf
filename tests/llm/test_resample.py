"""Importance resampling against a sort of everything."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import resample

SCHEMA = "doc_id long, text string, score long, rank string"


def brute(docs: list[tuple], target: list[str | None], percent: int, least: int, longest: int = 1) -> list[tuple]:
    corpus, wanted = Counter(), Counter()
    for _, text in docs:
        corpus.update(resample.crc32(f) % resample.BUCKETS for f in resample.features((text or "").encode(), longest))
    for text in target:
        wanted.update(resample.crc32(f) % resample.BUCKETS for f in resample.features((text or "").encode(), longest))
    s_all, t_all = sum(corpus.values()), sum(wanted.values())
    out = []
    for doc_id, text in docs:
        found = resample.features((text or "").encode(), longest)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((corpus[b] + 1) * (t_all + 10000)))) for b in (resample.crc32(f) % 10000 for f in found))
        out.append([doc_id, len(found), weight, None if doc_id is None else weight + resample.noise(doc_id), None, len(resample.features((text or "").encode()))])
    can = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(can[: percent * len(can) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("percent", "longest"), [(10, 1), (37, 2), (100, 1), (0, 1)])
def test_draw_is_sort(spark, percent, longest):
    """Nulls, empty and long texts, repeated ids with equal and other texts, clashing columns."""
    draw = random.Random(3)
    word = lambda: draw.choice(["Aa", "bb", "ümlaut", "日本", "x9", "tail", "go-on", "the"]) + draw.choice(["", "", str(draw.randrange(50))])
    docs = [(i, " ".join(word() for _ in range(draw.randrange(0, 60)))) for i in range(600)]
    docs += [(None, "no id " * 20), (1, None), (2, ""), (3, "?!"), (4, "long word " * 5000)] + [docs[9]] * 150 + [(10, "one other text " * 9)] * 3
    target = [None, "", "the tail the bb x9", "日本 ümlaut"]
    given = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], SCHEMA).repartition(5)
    got = resample.resample(given, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, target, percent, 20, longest)


def test_ranges_split_ties_and_runs_merge(spark):
    """Blocks of many runs, all of one score and one id: every range counted, the draw cut inside one."""
    rows = spark.range(5000).selectExpr("7L AS doc_id", "20L AS n_features", "0L AS weight", "CAST(id % 3 = 0 AS long) AS score", "id AS row").repartition(6)
    runs = resample._runs(rows).cache()
    blocks = runs.count()
    splitters = resample._splitters(runs, blocks, 9)
    sizes = resample._range_sizes(runs, splitters)
    assert len(splitters) == 8 and sum(sizes) == 5000 and max(sizes) < 1500
    before = [0, *np.cumsum(sizes).tolist()]
    drawn = resample._ranked(resample._pieces(runs, splitters, len(sizes) - 1), before[:-1], 4321).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, 4322))
    want = sorted(range(5000), key=lambda i: (-(i % 3 == 0), i))[:4321]
    assert [r.row for r in sorted(drawn, key=lambda r: r["rank"])] == want
    runs.unpersist()


def test_tournament():
    draw = random.Random(1)
    keys = [sorted((draw.randrange(40), draw.randrange(5), i * 1000 + j) for j in range(draw.randrange(1, 30))) for i in range(37)]
    blocks = [resample._Block([np.array([k[1] for k in b]), np.zeros(len(b), int), np.zeros(len(b), int), np.array([-k[0] for k in b]), np.array([k[2] for k in b])]) for b in keys]
    blocks.sort(key=lambda b: b.key(0))
    got = [int(x) for part in resample.merged(blocks, 250) for x in part[4]]
    assert got == [k[2] for k in sorted(k for b in keys for k in b)][:250]


def test_empty(spark):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resample.resample(none, target).count() == 0
    one = spark.createDataFrame([(1, "a " * 30, 1, "r")] * 10, SCHEMA)
    assert resample.resample(one, target).where("rank IS NOT NULL").count() == 1


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = sorted(duckdb.sql(resample.RESAMPLE_SQL).fetchall(), key=str)
    got = resample.resample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
