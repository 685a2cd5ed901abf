"""Numbered changes against a plain sequential version."""

from __future__ import annotations

import datetime
import math
import random
import zlib
from collections import defaultdict

from lodestone.llm import changes

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, city string, balance double, n long, status string"
START = datetime.datetime(2024, 1, 1)


def brute(rows: list[dict], batches: int = 8, patience: int = 5) -> list[tuple]:
    rows = [dict(x) for x in {tuple(r.items()) for r in rows}]
    rows = [r for r in rows if None not in (r["change_id"], r["client_id"], r["seq"])]
    seqs = defaultdict(set)
    for r in rows:
        seqs[r["client_id"]].add(r["seq"])
    live = []
    for r in rows:
        h = zlib.crc32(str(r["change_id"]).encode())
        if r["valid_at"] is None or h % 11 == 0:
            continue
        day = (r["valid_at"].date() - datetime.date(1970, 1, 1)).days + 2 * (h % 4)
        sound = r["balance"] is not None and math.isfinite(r["balance"])
        batch = max(1, min(batches, 1 + math.floor((day - 19723) * batches / 160)))
        live.append(r | {"n": sorted(seqs[r["client_id"]]).index(r["seq"]) + 1, "day": day, "batch": batch, "cents": math.floor(100 * r["balance"] + 0.5) if sound else None})
    out: list[list] = []
    state: dict = {}
    clock = None

    def take(client, batch, missed):
        s = state[client]
        while s["next"] in s["held"]:
            r = s["held"].pop(s["next"])
            city, cents = s["values"]
            if r["op"] == "I":
                city, cents = r["city"], r["cents"]
            elif r["op"] == "U":
                city, cents = city if r["city"] is None else r["city"], cents if r["cents"] is None else r["cents"]
            elif r["op"] == "D":
                city = cents = None
            s["values"], s["next"] = (city, cents), s["next"] + 1
            out.append([r["change_id"], client, "applied", batch, missed, city, cents, False])
            s["last"], missed = (len(out) - 1, r["op"]), 0

    for b in range(1, batches + 2):
        for client, s in state.items():
            while s["held"] and (b > batches or clock is not None and min(x["day"] for x in s["held"].values()) + patience <= clock):
                least = min(s["held"])
                missed, s["next"] = least - s["next"], least
                take(client, b, missed)
        now = sorted((r for r in live if r["batch"] == b), key=lambda r: (r["day"], r["change_id"], *((x is not None, x) for x in (r["op"], r["city"], r["cents"]))))
        for r in now:
            s = state.setdefault(r["client_id"], {"next": 1, "held": {}, "values": (None, None), "last": None})
            if r["n"] < s["next"] or r["n"] in s["held"]:
                out.append([r["change_id"], r["client_id"], "rejected", b, 0, None, None, False])
            else:
                s["held"][r["n"]] = r
                take(r["client_id"], b, 0)
        clock = max([r["day"] for r in now] + ([clock] if clock is not None else []), default=None)
    for s in state.values():
        if s["last"] and s["last"][1] != "D":
            out[s["last"][0]][-1] = True
    return sorted(map(str, map(tuple, out)))


def test_changes_are_applied_in_order(spark):
    """Gaps that open and expire, late and repeated rows, ties, nulls in each column, an empty batch, clashing columns, one hot client."""
    draw = random.Random(5)
    rows = []
    for i in range(700):
        client = 7 if draw.random() < 0.4 else draw.randrange(60)
        seq = draw.randrange(40 if client == 7 else 9)
        day = max(0, min(118, seq * (3 if client == 7 else 12) + draw.randrange(-8, 9)))
        day = day + 50 if 40 <= day < 60 else day  # the third batch gets hardly a row
        at = None if draw.random() < 0.03 else START + datetime.timedelta(days=day, hours=draw.randrange(24))
        balance = draw.choice([None, float("nan"), 12.345, -0.005, 99.995, round(draw.uniform(-99, 999), 2)])
        rows.append({"change_id": i, "client_id": client, "seq": seq, "op": draw.choice("IUUUD") if draw.random() > 0.03 else draw.choice([None, "X"]), "valid_at": at, "source": "s", "city": draw.choice([None, "a", "b"]), "balance": balance, "n": None, "status": "x"})
    rows += [dict(r) for r in rows[:40]]  # repeated
    rows += [r | {"source": "t"} for r in rows[40:60]]  # told apart by another column only
    rows += [r | {"city": "z"} for r in rows[60:80]]  # an id with other values
    rows += [rows[80] | {k: None} for k in ("change_id", "client_id", "seq", "city", "op")]
    rows = [r | {"balance": r["balance"] if r["balance"] == r["balance"] else None} for r in rows] + [rows[81] | {"change_id": 9001, "balance": float("inf")}]
    given = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = changes.applied(given)
    assert got.columns == ["change_id", "client_id", "n", "status", "batch", "missed", "city", "cents", "current"]
    found = sorted(str((r.change_id, r.client_id, r.status, r.batch, r.missed, r.city, r.cents, r.current)) for r in got.collect())
    assert found == brute(rows)
    assert any(r.missed for r in got.collect()) and got.where("status = 'rejected'").count() > 50


def test_dense_ranks_over_parts(spark):
    pairs = spark.range(4000).selectExpr("CASE WHEN id % 3 > 0 THEN 7 ELSE id % 50 END AS client_id", "id * 3 AS seq", "id AS other")
    ranks = changes._dense_ranks(pairs)
    assert ranks.columns == ["client_id", "seq", "other", "n"]
    pairs.createOrReplaceTempView("pairs_of_clients")
    assert ranks.exceptAll(spark.sql("SELECT *, cast(dense_rank() OVER (PARTITION BY client_id ORDER BY seq) AS bigint) FROM pairs_of_clients")).count() == 0


def test_no_changes(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert changes.numbered(none).count() == 0 and changes.applied(none).count() == 0


def test_clock_rows_of_clients_that_hold_something(spark, tmp_path):
    # Client 1 has been told all, 2 and 3 hold something, and 3 has a change in the batch.
    sizes = spark.createDataFrame([(1, 1, 2, True), (2, 1, 2, True), (3, 2, 1, True), (3, 3, 1, True), (4, 3, 1, True)], "client_id long, batch int, n long, active boolean")
    told = [(["7", "1", "1", "applied", "1", "0", None, None, "I"],), (["8", "1", "2", "applied", "1", "0", None, None, "U"],), (["9", "2", "1", "rejected", "1", "0", None, None, "U"],)]
    outbox = str(tmp_path / "told")
    spark.createDataFrame(told, changes.OUT).write.parquet(outbox)
    assert [tuple(r) for r in changes._waiting(spark, sizes, outbox, 3).collect()] == [(2, True, None)]
