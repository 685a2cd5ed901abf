"""Log lines: times, levels, classes, file names and incident windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lines of a file that are worked out together, and keywords that are sent to tasks at once.
BLOCK, KEYWORDS_AT_ONCE = 100_000, 200_000
#: A rolled file's name: component, then seventeen digits.
FILE = r"^(.+)-([0-9]{17})\.log$"
#: An entry: time to the second, level, thread and logger; milliseconds may be there or not, and the message isn't read.
ENTRY = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})[.\d]*\s+(\w+)\s+\[[^\]]+\]\s+([\w$.]+)"
STAMP = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3})"


def line_time(line: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(line, STAMP, 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))


def line_parts(line: Column) -> dict[str, Column]:
    """Time to the second, upper-cased level and simple class name; the message is not kept.

    All are null for a line that is no entry or has a date that there is not.
    """
    part = lambda n: F.regexp_extract(line, ENTRY, n)
    entry = F.try_to_timestamp(F.nullif(part(1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull()
    return {
        "time": F.when(entry, F.concat(F.replace(part(1), F.lit(" "), F.lit("T")), F.lit("Z"))),
        "level": F.when(entry, F.upper(part(2))),
        "class_name": F.when(entry, F.substring_index(part(3), ".", -1)),
    }


def entries(lines: DataFrame, *others: str) -> DataFrame:
    """``others`` and the parts of the lines that are entries; all other lines are left out."""
    return lines.select(*others, *[x.alias(n) for n, x in line_parts(F.col("line")).items()]).where("time IS NOT NULL")


def hhmm(value: str) -> str:
    """A time of day as given by a caller; raises ``ValueError`` if it is none."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})", value or "")
    if not m or int(m[1]) > 23 or int(m[2]) > 59:
        raise ValueError("a time is given as HH:MM")
    return f"{int(m[1]):02d}:{m[2]}"


def hhmm_of(value: Column) -> Column:
    """The same as a column; null where it is no time of day."""
    hour, minute = (F.regexp_extract(value, r"^([0-9]{1,2}):([0-9]{2})$", n).try_cast("int") for n in (1, 2))
    return F.when((hour <= 23) & (minute <= 59), F.format_string("%02d:%02d", hour, minute))


def _blocked(lines: DataFrame, order: str, block: int) -> DataFrame:
    """``block``: the part of its file that a line is in, by its number."""
    return lines.withColumn("__block", F.floor(F.col(order) / block).cast("long"))


def with_carried_time(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``at``: the line's time, or that of the last line before it in the file that has one.

    Lines without file or number belong to no file and are left out. A scan in two steps: each block of a file is worked out by itself, and what the blocks before
    hand on is joined to it, so that a file of any length is spread over tasks.
    """
    at = _blocked(lines, "line_no", block).withColumn("__at", line_time(F.col("line")))
    handed = at.where("__at IS NOT NULL").groupBy("file", "__block").agg(F.max_by("__at", "line_no").alias("__last"))
    every = at.select("file", "__block").distinct().join(handed, ["file", "__block"], "left")
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("file", "__block", F.last("__last", ignorenulls=True).over(before).alias("__before"))
    w = Window.partitionBy("file", "__block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    own = at.withColumn("__own", F.last("__at", ignorenulls=True).over(w))
    return own.join(carried, ["file", "__block"]).withColumn("at", F.coalesce("__own", "__before")).select(*lines.columns, "at")


def in_time(lines: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Lines from HH:MM to HH:MM, both included, on any day; a start after the end gives none."""
    minute = F.date_format("at", "HH:mm")
    return with_carried_time(lines).where("at IS NOT NULL").where((minute >= hhmm(start) if start else F.lit(True)) & (minute <= hhmm(end) if end else F.lit(True))).drop("at")


def tail(lines: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """The last n lines of each file: by the sizes of its blocks, only the block in which the tail begins is sorted."""
    rows = _blocked(lines, "line_no", block)
    after = Window.partitionBy("file").orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("__size")).withColumn("__after", F.coalesce(F.sum("__size").over(after), F.lit(0)))
    met = rows.join(sizes.where(F.col("__after") < n), ["file", "__block"])
    whole = met.where(F.col("__after") + F.col("__size") <= n)
    w = Window.partitionBy("file", "__block").orderBy(F.desc("line_no"))
    part = met.where(F.col("__after") + F.col("__size") > n).withColumn("__n", F.row_number().over(w)).where(F.col("__after") + F.col("__n") <= n)
    return whole.select(*lines.columns).unionByName(part.select(*lines.columns))


def including(lines: DataFrame, text: str) -> DataFrame:
    return lines.where(F.contains(F.lower("line"), F.lit(text.lower())))


def excluding(lines: DataFrame, text: str) -> DataFrame:
    return lines.where(~F.contains(F.lower("line"), F.lit(text.lower())))


def folded(hits: DataFrame, keys: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """Runs of equal (level, class_name) in order: first time, number of hits and the event's text.

    Each block says with what it begins and ends and how many runs begin inside it; whether a
    block goes on with the run before, and the runs' numbers, follow from the blocks alone.
    """
    rows = _blocked(hits, order, block)
    this = F.struct("level", "class_name")
    w = Window.partitionBy(*keys, "__block").orderBy(order)
    rows = rows.withColumn("__first", F.row_number().over(w) == 1)
    rows = rows.withColumn("__new", F.when(F.col("__first") | F.lag(this).over(w).eqNullSafe(this), 0).otherwise(1))
    ends = rows.groupBy(*keys, "__block").agg(F.min_by(this, order).alias("__begin"), F.max_by(this, order).alias("__end"), F.sum("__new").alias("__inside"))
    over = Window.partitionBy(*keys).orderBy("__block")
    goes_on = F.lag("__end").over(over).eqNullSafe(F.col("__begin")) & (F.row_number().over(over) > 1)
    ends = ends.withColumn("__opens", F.when(goes_on, 0).otherwise(1))
    before = F.coalesce(F.sum(F.col("__inside") + F.col("__opens")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("__base", before + F.col("__opens")).select(*keys, "__block", "__base")
    runs = rows.withColumn("__sum", F.sum("__new").over(w)).join(ends, [*keys, "__block"]).withColumn("run", F.col("__base") + F.col("__sum"))
    out = runs.groupBy(*keys, "run").agg(F.min_by("time", order).alias("time"), F.first("level").alias("level"), F.first("class_name").alias("class_name"), F.count(F.lit(1)).alias("n"))
    event = F.concat("time", F.lit(" ["), "level", F.lit("]["), "class_name", F.lit("]"))
    return out.withColumn("event", F.when(F.col("n") > 1, F.concat(event, F.format_string(" (x%d times)", F.col("n")))).otherwise(event))


def keyword_hits(lines: DataFrame, tasks: DataFrame) -> DataFrame:
    """``lines`` with ``kw``, a row for each keyword of the line's file (``tasks``: file, kw) that the line contains, whatever its case.

    Each line is read once by an automaton of all distinct keywords, so the time doesn't grow with
    their number; a keyword found is kept if a task asks for it in that file. Keywords are sent
    to the tasks, ``KEYWORDS_AT_ONCE`` at most; more are looked for in several passes.
    """
    kinds = tasks.where("kw IS NOT NULL").select("kw").distinct()
    parts = max(1, -(-kinds.count() // KEYWORDS_AT_ONCE))
    found = None
    for i in range(parts):
        words = [r.kw for r in kinds.where(F.pmod(F.xxhash64("kw"), F.lit(parts)) == i).collect()]
        some = _with_keywords(lines, words)
        found = some if found is None else found.unionByName(some)
    return found.join(tasks.select("file", "kw").distinct(), ["file", "kw"], "left_semi").select(*lines.columns, "kw")


def _with_keywords(lines: DataFrame, words: list[str]) -> DataFrame:
    import ahocorasick

    machine = ahocorasick.Automaton()
    for w in words:
        if w:
            machine.add_word(w, w)
    machine.make_automaton()
    sent = lines.sparkSession.sparkContext.broadcast((machine, "" in words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, every = sent.value
        for batch in batches:
            rows, kws = [], []
            for i, line in enumerate(batch.column(0)):
                if (text := line.as_py()) is None:
                    continue
                met = {w for _, w in machine.iter(text)} if len(machine) else set()
                met |= {""} if every else set()
                rows += [i] * len(met)
                kws += sorted(met)
            if kws:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns[1:], pa.array(kws, pa.string())], names=[*batch.schema.names[1:], "kw"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields), "kw string"])
    return lines.select(F.lower("line").alias("__low"), "*").mapInArrow(run, schema)


def file_time(name: Column) -> Column:
    return F.try_to_timestamp(F.left(F.nullif(F.regexp_extract(name, "([0-9]{17})", 1), F.lit("")), F.lit(14)), F.lit("yyyyMMddHHmmss"))


def flexible_time(value: Column) -> Column:
    """Fourteen digits, a date and time with a space, or ISO."""
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(p)) for p in ("yyyyMMddHHmmss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")])


def incident_window(incident: Column, now: Column) -> dict[str, Column]:
    """Three hours before to one after an incident, else the last six hours; files from three hours earlier on."""
    start = F.coalesce(incident - F.expr("INTERVAL 3 HOURS"), now - F.expr("INTERVAL 6 HOURS"))
    return {"start": start, "end": F.coalesce(incident + F.expr("INTERVAL 1 HOUR"), now), "cutoff": start - F.expr("INTERVAL 3 HOURS")}


def file_kept(at: Column, start: Column, end: Column) -> Column:
    """Files whose time can't be read are kept."""
    return at.isNull() | ((at <= end) & (at >= start - F.expr("INTERVAL 3 HOURS")))


def first_servers(catalog: DataFrame) -> DataFrame:
    """(environment, type, tag, base_url): the first server (by pos) of each tag in a catalogue (environment, type, tags, base_url, pos)."""
    tagged = catalog.select("environment", "type", F.explode(F.split("tags", ",")).alias("tag"), "base_url", "pos")
    return tagged.groupBy("environment", "type", "tag").agg(F.min_by("base_url", "pos").alias("base_url"))


def planned(sources: DataFrame, catalog: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """``sources`` (plan, environment, type, tags, start, stop, ...) with the servers that hold their logs, a row for each.

    A source without start or end has its plan's, the earliest and the latest of all its sources;
    a plan without any begins ``hours`` before now and ends an hour more after its beginning.
    A tagged log server is looked up for each tag, a Loki server once for the environment.
    Sources without tags, of another type or without a server give no row.
    """
    spans = sources.groupBy("plan").agg(F.min("start").alias("__a"), F.max("stop").alias("__b"))
    begin = F.coalesce("__a", now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    met = sources.join(spans, "plan").withColumns({"start": F.coalesce("start", begin), "stop": F.coalesce("stop", "__b", begin + F.make_dt_interval(F.lit(0), F.lit(hours + 1)))}).drop("__a", "__b").where(F.size("tags") > 0)
    tailed = met.where("type = 'logtail'").select("*", F.explode("tags").alias("tag")).join(first_servers(catalog), ["environment", "type", "tag"]).drop("tag")
    servers = catalog.where("type = 'loki'").groupBy("environment").agg(F.min_by("base_url", "pos").alias("base_url"))
    return tailed.unionByName(met.where("type = 'loki'").join(servers, "environment").select(tailed.columns))
