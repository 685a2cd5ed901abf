"""Numbered changes applied in order, by a stateful Structured Streaming query.

Changes of a client carry a sequence value; its dense rank within the client is the number
``n``. Changes arrive in batches and are held until all numbers before theirs have been
applied. A gap that stays open for too long is jumped.

State is kept for each client with ``transformWithState``: a map of the held changes by
number, and a value with the next number to apply and the current values. A micro-batch is one batch of
changes; every client that holds something from earlier batches and has no change in it gets a
clock row, so that gaps expire on time: what has been fed and not yet told is held, and a client
that holds nothing has no gap to expire. Each batch is a new start of the query on one checkpoint, so any
start may be repeated after a lost driver.

A number can only be taken by its first change in order of day, so the first changes are found
beforehand by a partial aggregate; all others of the number are fed as well, but rejected
without going through the client's state. A client with a great share of all changes is thereby
reduced to its numbers before anything is gathered by client. Dense ranks come from a range
partitioning by client and value, ranked by part and offset by the sizes of the parts before,
so that no task holds all of one client's values.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row
from pyspark.sql.window import Window

from lodestone.scratch import keep, new_path

BATCHES, FIRST_DAY, DAYS = 8, 19723, 160
#: Days after its own that the oldest held change waits before the gap is jumped.
PATIENCE = 5
#: The clock of the batch after the last.
_NEVER = (1 << 31) - 1
#: A change goes to the state and comes back as one column, since each column of each row and each client costs time there.
CHANGE = {"n": "long", "day": "int", "change_id": "long", "op": "string", "city": "string", "cents": "long"}
FED = "client_id long, batch int, leads boolean, change array<string>"
ENTRY = {"change_id": "long", "client_id": "long", "n": "long", "status": "string", "batch": "int", "missed": "long", "city": "string", "cents": "long", "op": "string"}
OUT = "entry array<string>"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Applier(StatefulProcessor):
    """Applies a client's changes in the order of their numbers; a row without a change only says that time has passed.

    One is made for each start: ``clock`` is the largest day of the batches before, if there is one.
    """

    def __init__(self, batch: int, clock: int | None, patience: int = PATIENCE) -> None:
        self.batch, self.clock, self.patience = batch, clock, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "next long, held long, earliest int, city string, cents long")
        self.held = handle.getMapState("held", "n long", "day int, change_id long, op string, city string, cents long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clock = self.clock
        fresh = sorted((_read(r.change) for r in rows if r.change is not None), key=_order)
        state = self.state.get()
        following, n_held, earliest, *values = state = state if state is not None else (1, 0, None, None, None)
        due = bool(n_held) and clock is not None and earliest + self.patience <= clock
        if not fresh and not due:
            return
        stored = {k[0]: tuple(v) for k, v in self.held.iterator()} if n_held else {}
        held, out = dict(stored), []

        def release(missed: int) -> None:
            nonlocal following, values
            while following in held:
                _, change_id, op, city, cents = held.pop(following)
                if op == "U":
                    values = [old if new is None else new for old, new in zip(values, (city, cents))]
                elif op in ("I", "D"):
                    values = [city, cents] if op == "I" else [None, None]
                out.append(self._entry(change_id, key[0], following, "applied", missed, *values, op))
                following, missed = following + 1, 0

        if due:
            days, numbers = [(v[0], n) for n, v in held.items()], list(held)
            heapq.heapify(days)
            heapq.heapify(numbers)
            while held:
                while days[0][1] not in held:
                    heapq.heappop(days)
                if days[0][0] + self.patience > clock:
                    break
                while numbers[0] not in held:
                    heapq.heappop(numbers)
                missed, following = numbers[0] - following, numbers[0]
                release(missed)
        for n, *change in fresh:
            if n < following or n in held:
                out.append(self._entry(change[1], key[0], n, "rejected", 0, None, None, change[2]))
            else:
                held[n] = tuple(change)
                release(0)

        for n in stored.keys() - held.keys():
            self.held.removeKey((n,))
        for n in held.keys() - stored.keys():
            self.held.updateValue((n,), held[n])
        last = (following, len(held), min((v[0] for v in held.values()), default=None), *values)
        if last != state:
            self.state.update(last)
        yield from out

    def _entry(self, change_id: int, client: int, n: int, status: str, missed: int, city: str | None, cents: int | None, op: str | None) -> Row:
        return Row(entry=[str(change_id), str(client), str(n), status, str(self.batch), str(missed), city, None if cents is None else str(cents), op])

    def close(self) -> None:
        pass


def _read(change: list[str | None]) -> tuple:
    n, day, change_id, op, city, cents = change
    return int(n), int(day), int(change_id), op, city, None if cents is None else int(cents)


def _order(change: tuple) -> tuple:
    """By day and change; rows that repeat a change by what they hold, nulls first."""
    return (*change[1:3], *((x is not None, x) for x in change[3:]))


def _hash(change_id: Column) -> Column:
    return F.crc32(change_id.cast("string").cast("binary"))


def numbered(changes: DataFrame) -> DataFrame:
    """The distinct ``changes`` with their number, day and batch, and whether they lead theirs.

    ``n`` is the dense rank of ``seq`` within the client, over all distinct rows. Rows without
    change, client or sequence value aren't counted; after ranking, rows without ``valid_at``
    and those whose hash is divisible by 11 vanish. ``leads`` marks the first change of a number
    by day and id; rows that tie in all that is read lead together. Balances that are no number
    count as null. Other columns only tell rows apart.
    """
    rows = changes.distinct().where("change_id IS NOT NULL AND client_id IS NOT NULL AND seq IS NOT NULL")
    h = _hash(F.col("change_id"))
    day = (F.unix_date(F.col("valid_at").cast("date")) + 2 * (h % 4)).cast("int")
    sound = F.col("balance").isNotNull() & ~F.isnan("balance") & (F.abs("balance") < 9e16)
    cents = F.when(sound, F.floor(F.when(sound, F.col("balance")) * 100 + 0.5).cast("long"))
    rows = rows.select(
        F.col("client_id").cast("long").alias("client_id"), F.col("seq").cast("long").alias("seq"), day.alias("day"), F.col("change_id").cast("long").alias("change_id"),
        F.col("op").cast("string").alias("op"), F.col("city").cast("string").alias("city"), cents.alias("cents"), (F.col("valid_at").isNotNull() & (h % 11 != 0)).alias("stays"),
    )
    rows = keep(rows, "changes-distinct")
    order = F.struct("day", "change_id", "op", "city", "cents")
    pairs = rows.groupBy("client_id", "seq").agg(F.min(F.when(F.col("stays"), order)).alias("first"))
    batch = F.greatest(F.lit(1), F.least(F.lit(BATCHES), (1 + F.floor((F.col("day") - FIRST_DAY) * BATCHES / DAYS)).cast("int")))
    joined = rows.where("stays").join(_dense_ranks(pairs), ["client_id", "seq"])
    return joined.select("client_id", "n", "day", "change_id", "op", "city", "cents", batch.alias("batch"), order.eqNullSafe(F.col("first")).alias("leads"))


def _dense_ranks(pairs: DataFrame) -> DataFrame:
    """Distinct (client_id, seq) with the dense rank ``n`` of seq, and the columns given."""
    parts = keep(pairs.repartitionByRange("client_id", "seq").withColumn("part", F.spark_partition_id()), "changes-numbers")
    sizes = parts.groupBy("client_id", "part").agg(F.count(F.lit(1)).alias("size"))
    earlier = F.sum("size").over(Window.partitionBy("client_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("client_id", "part", F.coalesce(earlier, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("client_id", "part").orderBy("seq"))
    return parts.withColumn("within", within).join(before, ["client_id", "part"]).withColumn("n", F.col("before") + F.col("within")).drop("part", "within", "before")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _clocks(rows: DataFrame) -> dict[int, int | None]:
    """The largest day of the batches before each batch: a number for a batch is all that the driver gets."""
    largest = {r.batch: r.day for r in rows.groupBy("batch").agg(F.max("day").alias("day")).collect()}
    return {b: max((d for x, d in largest.items() if x < b), default=None) for b in range(1, BATCHES + 1)} | {BATCHES + 1: _NEVER}


def _waiting(spark: SparkSession, sizes: DataFrame, outbox: str, batch: int) -> DataFrame:
    """Clock rows of a batch: for each client without a change that leads in it, of whose earlier changes some aren't told yet, so that its state holds them."""
    fed = sizes.where(F.col("batch") < batch).groupBy("client_id").agg(F.sum("n").alias("fed"))
    told = spark.read.schema(OUT).parquet(outbox).select(F.col("entry")[1].cast("long").alias("client_id")).groupBy("client_id").agg(F.count(F.lit(1)).alias("told"))
    active = sizes.where((F.col("batch") == batch) & F.col("active")).select("client_id")
    holding = fed.join(told, "client_id", "left").where(F.col("fed") > F.coalesce("told", F.lit(0)))
    return holding.join(active, "client_id", "left_anti").select("client_id", F.lit(True).alias("leads"), F.lit(None).cast("array<string>").alias("change"))


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Put a written batch before the query: a folder is renamed, or an empty one made for a batch without rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)) if files.exists(path(source)) else not files.mkdirs(path(target)):
        raise OSError(f"{source} can't be moved to {target}")


def applied(changes: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """change_id, client_id, n, status, batch, missed, city, cents and current for each numbered change.

    ``changes`` are read as ``numbered`` says; the values are those after the change, null where
    it was rejected. An operation other than I, U and D changes no value. ``current`` marks the
    change that a client ends with, unless it deletes. Without changes the result is empty.
    """
    spark = changes.sparkSession
    given = keep(numbered(changes), "changes-numbered")
    staged, inbox, outbox, state = (new_path(spark, f"changes-{x}") for x in ("staged", "inbox", "outbox", "state"))
    parts, cores = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    fed = given.select("client_id", "batch", "leads", F.array(*[F.col(x).cast("string") for x in CHANGE]).alias("change"))
    fed.repartition("batch", F.pmod(F.xxhash64("client_id", "change"), F.lit(parts))).write.partitionBy("batch").parquet(staged)
    sizes = keep(given.groupBy("client_id", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("leads").alias("active")), "changes-sizes")
    at, running = {x: F.col("change")[i] for i, x in enumerate(CHANGE)}, None
    # The state is dealt into whole rounds of the cores.
    with _settings(spark, _STATE | {"spark.sql.shuffle.partitions": str(-(-parts // cores) * cores)}):
        for batch, clock in _clocks(given).items():
            if running is not None:
                _waiting(spark, sizes, outbox, batch).write.mode("append").parquet(f"{staged}/batch={batch}")
            _move(spark, f"{staged}/batch={batch}", f"{inbox}/batch={batch}")
            fed = spark.readStream.schema(FED).parquet(inbox)
            kept = fed.where("leads").select("client_id", "change").groupBy("client_id").transformWithState(Applier(batch, clock, patience), OUT, "Append", "None")
            told = {"client_id": F.col("client_id"), "status": F.lit("rejected"), "batch": F.col("batch"), "missed": F.lit(0), "city": F.lit(None), "cents": F.lit(None)}
            others = fed.where("NOT leads").select(F.array(*[told.get(x, at.get(x)).cast("string") for x in ENTRY]).alias("entry"))
            running = kept.unionByName(others).writeStream.format("parquet").option("path", outbox).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
            running.awaitTermination()
    done = spark.read.schema(OUT).parquet(outbox).select(*[F.col("entry")[i].cast(kind).alias(x) for i, (x, kind) in enumerate(ENTRY.items())])
    ends = done.where("status = 'applied'").groupBy("client_id").agg(F.max_by(F.struct("n", "op"), "n").alias("end")).select("client_id", "end.n", (F.coalesce(F.col("end.op"), F.lit("")) != "D").alias("lives"))
    found = done.join(ends, ["client_id", "n"], "left")
    return found.select("change_id", "client_id", "n", "status", "batch", "missed", "city", "cents", F.coalesce(F.col("lives") & (F.col("status") == "applied"), F.lit(False)).alias("current"))
