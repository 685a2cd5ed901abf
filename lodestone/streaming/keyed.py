"""Keyed state over micro-batches: circuit breakers and serial request queues.

Both read a folder of Parquet files as they arrive, keep a value for each connector or queue,
and go on from their checkpoint after a restart. Within a micro-batch the calls of a key are
taken in the order of their times; micro-batches are expected to be in order. The steps of a
trip that lie in the future are due times kept in the state: they are told with the first call
that is later, and the rest when the stream is closed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from lodestone.streaming.logs import CLOSED_S, FAILURES, HALF_OPEN_S

#: A time after all others, by which a stream is closed.
END_US = 1 << 62
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


class Breaker(StatefulProcessor):
    """Trips at each fifth failure; half open and closed follow when their time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "failures int, due array<struct<at_us:bigint,state:string>>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = self.state.get()
        failures, due = (got[0], [(x[0], x[1]) for x in got[1]]) if got is not None else (0, [])
        for r in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            told = [x for x in due if x[0] < r.at_us]
            due = [x for x in due if x[0] >= r.at_us]
            failures += r.failed
            if r.failed and failures == FAILURES:
                failures = 0
                told.append((r.at_us, "OPEN"))
                due += [(r.at_us + HALF_OPEN_S * 1_000_000, "HALF_OPEN"), (r.at_us + CLOSED_S * 1_000_000, "CLOSED")]
            for at, state in sorted(told):
                yield Row(connector=key[0], at_us=at, state=state)
        self.state.update((failures, due))

    def close(self) -> None:
        pass


class Queue(StatefulProcessor):
    """Requests of a queue one after the other: each begins at its own time or when the one before has ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "free_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        got = self.state.get()
        free = got[0] if got is not None else -END_US
        for r in sorted(rows, key=lambda r: (r.at_us, r.seq)):
            free = max(free, r.at_us) + r.work_us
            yield Row(seq=r.seq, done_us=free)
        self.state.update((free,))

    def close(self) -> None:
        pass


@contextmanager
def _with_state(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _run(stream: DataFrame, out: str, checkpoint: str) -> None:
    with _with_state(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def breakers(spark: SparkSession, inbox: str, out: str, checkpoint: str) -> None:
    """Work on what has arrived in ``inbox`` (connector, seq, at_us, failed) since the last call; ``out`` gets (connector, at_us, state)."""
    calls = spark.readStream.schema("connector string, seq long, at_us long, failed boolean").parquet(inbox)
    _run(calls.groupBy("connector").transformWithState(Breaker(), "connector string, at_us long, state string", "Append", "None"), out, checkpoint)


def queues(spark: SparkSession, inbox: str, out: str, checkpoint: str) -> None:
    """Work on the requests that have arrived in ``inbox`` (queue, seq, at_us, work_us); ``out`` gets (seq, done_us)."""
    calls = spark.readStream.schema("queue string, seq long, at_us long, work_us long").parquet(inbox)
    _run(calls.groupBy("queue").transformWithState(Queue(), "seq long, done_us long", "Append", "None"), out, checkpoint)


def closing(connectors: DataFrame) -> DataFrame:
    """A call for each connector after all others, with which the steps still due are told."""
    return connectors.select("connector", F.lit(0).cast("long").alias("seq"), F.lit(END_US).alias("at_us"), F.lit(False).alias("failed"))
