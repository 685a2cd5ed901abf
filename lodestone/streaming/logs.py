"""Streams: tailed log files and a circuit breaker for connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import logs as L

FAILURES, HALF_OPEN_S, CLOSED_S = 5, 30, 60


def tail_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of lines with their file, component and parsed parts; the message goes no further."""
    lines = spark.readStream.text(path).select(F.col("value").alias("line"), F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"))
    named = lines.withColumn("component", F.coalesce(F.nullif(F.regexp_extract("file", L.FILE, 1), F.lit("")), F.col("file")))
    return named.where("trim(line) <> ''").select("component", "file", *[x.alias(n) for n, x in L.line_parts(F.col("line")).items()])


def tail_folders(spark: SparkSession, path: str) -> DataFrame:
    """As ``tail_files`` over folders ``component=.../file=...``, whose names are the lines' labels."""
    lines = spark.readStream.schema("value string, component string, file string").text(path).where("trim(value) <> ''")
    return lines.select("component", "file", *[x.alias(n) for n, x in L.line_parts(F.col("value")).items()])


def retained(rows: DataFrame, at: str, now, days: int = 31) -> DataFrame:
    """Old rows are accepted; rows from more than ``days`` ahead are not."""
    return rows.where(F.col(at) <= now + F.make_dt_interval(F.lit(days)))


def retried(calls: DataFrame, delay_ms: int = 200) -> DataFrame:
    """``calls`` (failed: whether each attempt fails) after two attempts: done, or given up to the recovery."""
    again = F.col("failed")[0]
    state = F.when(again & F.col("failed")[1], "recovered").otherwise("done")
    return calls.withColumns({"attempts": F.when(again, 2).otherwise(1), "waited_ms": F.when(again, delay_ms).otherwise(0), "state": state})


def tried(calls: DataFrame, delays: tuple[int, ...] = (10, 20)) -> DataFrame:
    """``calls`` (failed) with the number of attempts, ``wait``: microseconds waited before them, and the state after the last."""
    failed = F.col("failed")
    tries = F.size(F.filter(F.sequence(F.lit(0), F.lit(len(delays))), lambda i: (i == 0) | F.forall(F.slice(failed, F.lit(1), i), lambda f: f)))
    waits = F.aggregate(F.slice(F.array(*map(F.lit, delays)), F.lit(1), F.col("attempts") - 1), F.lit(0), lambda a, x: a + x)
    state = F.when(F.forall(F.slice(failed, 1, len(delays) + 1), lambda f: f), "failed").otherwise("done")
    return calls.withColumn("attempts", tries).withColumn("wait", waits.cast("long") * 1_000_000).withColumn("state", state)


def queued(calls: DataFrame, queue: str, seq: str, delays: tuple[int, ...] = (10, 20)) -> DataFrame:
    """``calls`` (at, failed) through serial queues: attempts, time of the end in microseconds, and state.

    A request waits for those before it in its queue; it is tried again after each of
    ``delays`` seconds and fails with the last attempt. A request begins at its own time or at
    the end of the one before, so with the work before it summed up the ends are a running
    maximum: no loop over requests.
    """
    rows = tried(calls, delays)
    order = Window.partitionBy(queue).orderBy("at", seq)
    rows = rows.withColumn("work", F.sum("wait").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begun = F.max(F.unix_micros("at") - (F.col("work") - F.col("wait"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("done_us", begun + F.col("work")).drop("wait", "work")


def breaker_states(calls: DataFrame) -> DataFrame:
    """(connector, at, state): OPEN at each fifth failure, HALF_OPEN and CLOSED 30 and 60 seconds later.

    ``calls`` has connector, seq, at and failed. Failures are counted without a window and
    from nothing again after a trip, here in order of arrival.
    """
    w = Window.partitionBy("connector").orderBy("at", "seq")
    failed = calls.where("failed").withColumn("n", F.row_number().over(w)).where(F.col("n") % FAILURES == 0)
    steps = F.array(*[F.struct((F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(s)).cast("decimal(18,6)"))).alias("at"), F.lit(n).alias("state")) for n, s in (("OPEN", 0), ("HALF_OPEN", HALF_OPEN_S), ("CLOSED", CLOSED_S))])
    return failed.select("connector", F.explode(steps).alias("s")).select("connector", "s.at", "s.state")
