"""Scans of long log files by blocks, keywords by an automaton, and numbered lines by ranges of bytes, against plain versions."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import logs as L
from lodestone.sources import files


def made(seed: int, n: int = 60) -> list[tuple]:
    draw = random.Random(seed)
    rows = []
    for file in ("a", "b"):
        number = 0
        for _ in range(n):
            number += draw.choice([1, 1, 1, 3])
            stamp = f"2026-04-11 {draw.randrange(24):02d}:{draw.randrange(60):02d}:00.000 {draw.choice(['INFO', 'WARN'])} [m] x.{draw.choice('AB')} - t"
            rows.append((file, number, draw.choice([stamp, stamp, "  at more", "2026-13-40 10:00:00.000 INFO [m] a.B - x"])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_scans_by_blocks(spark, block):
    rows = made(block)
    lines = spark.createDataFrame(rows, "file string, line_no long, line string")
    carried, runs = {}, {}
    for file in ("a", "b"):
        last, previous, n = None, None, 0
        for _, number, line in sorted(r for r in rows if r[0] == file):
            sound = line.startswith("2026-04")
            last = line[:23] if sound else last
            carried[file, number] = last
            if sound:
                this = (line.split()[2], line.split()[4][2:])
                n += this != previous
                previous = this
                runs.setdefault((file, n), []).append(this)
    got = L.with_carried_time(lines, block)
    assert got.columns == [*lines.columns, "at"]
    assert {(r.file, r.line_no): r.at and r.at.strftime("%Y-%m-%d %H:%M:%S.000") for r in got.collect()} == carried
    folded = L.folded(L.entries(lines, "file", "line_no"), ["file"], "line_no", block).collect()
    assert {(r.file, r.run): (r.n, r.level, r.class_name) for r in folded} == {k: (len(v), *v[0]) for k, v in runs.items()}
    for n in (0, 1, 5, 59, 500):
        want = {(f, x) for f in ("a", "b") for x in sorted(r[1] for r in rows if r[0] == f)[max(0, 60 - n) :]}
        assert {(r.file, r.line_no) for r in L.tail(lines, n, block).collect()} == want


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], "file string, line_no long, line string")
    assert L.with_carried_time(none).count() == 0 and L.tail(none, 3).count() == 0
    assert L.folded(L.entries(none, "file", "line_no"), ["file"], "line_no").count() == 0


@pytest.mark.parametrize("most", [200_000, 2])
def test_keywords_by_an_automaton(spark, monkeypatch, most):
    monkeypatch.setattr(L, "KEYWORDS_AT_ONCE", most)
    lines = [("f", 1, "Error in ERRORS"), ("f", 2, None), ("f", 3, ""), ("g", 1, "an error"), ("g", 2, "ÜBER a+b"), ("h", 1, "error")]
    tasks = [("f", "error"), ("f", "errors"), ("f", "error"), ("g", "über"), ("g", "a+b"), ("g", ""), ("h", "none"), ("h", None), (None, "error")]
    got = L.keyword_hits(spark.createDataFrame(lines, "file string, line_no long, line string"), spark.createDataFrame(tasks, "file string, kw string"))
    want = {(f, n, k) for f, n, line in lines if line is not None for g, k in tasks if f == g and k is not None and k in line.lower()}
    found = [(r.file, r.line_no, r.kw) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("size", [1, 3, 16, 1 << 20])
def test_numbered_lines(spark, tmp_path, size):
    texts = {"a.log": b"one\ntwo\r\nthree\rfour\n\nlast \xff\xe9", "b.log": b"", "c.log": b"\n\n", "d/e.log": "ü\n日本\n".encode() * 5, "skip.txt": b"no\n"}
    for name, content in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    (tmp_path / "z.gz").write_bytes(gzip.compress(b"x\ny\n"))
    want = {}
    for name in ("a.log", "b.log", "c.log", "d/e.log"):
        with open(tmp_path / name, encoding="utf-8", errors="replace") as f:
            want |= {(name, i + 1): line.rstrip("\n") for i, line in enumerate(f)}
    read = lambda suffix: {(r.path.removeprefix(str(tmp_path) + "/"), r.line_no): r.line for r in files.read_numbered_lines(spark, str(tmp_path), size, suffix).collect()}
    assert read(".log") == want
    if size > 3:
        assert read(".gz") == {("z.gz", 1): "x", ("z.gz", 2): "y"}
        assert files.read_numbered_lines(spark, str(tmp_path), size, ".none").count() == 0


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(3000)))
    rows = files.read_numbered_lines(spark, str(tmp_path / "big.log"), 4096)
    assert rows.where(F.concat(F.lit("line "), F.col("line_no") - 1) == F.col("line")).count() == 3000
    assert spark.read.format("text_ranges").options(path=str(tmp_path / "big.log"), range="4096").load().rdd.getNumPartitions() > 5
