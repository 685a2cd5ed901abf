"""Queries of the log operators, over events written as log lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import logs as L
from lodestone.plans.base import LOG_LINES_SQL, query
from lodestone.scratch import keep, new_path
from lodestone.sources import files

c = F.col
W = f"WITH {LOG_LINES_SQL}"
_TS = r"try_strptime(nullif(regexp_extract(line, '^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3})', 1), ''), '%Y-%m-%d %H:%M:%S.%g')"
_FORM = r"'^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})[.\d]*\s+(\w+)\s+\[[^\]]+\]\s+([\w$.]+)'"
_IS_ENTRY = f"try_strptime(nullif(regexp_extract(line, {_FORM}, 1), ''), '%Y-%m-%d %H:%M:%S') IS NOT NULL"
_PARTS = f"strftime(try_strptime(nullif(regexp_extract(line, {_FORM}, 1), ''), '%Y-%m-%d %H:%M:%S'), '%Y-%m-%dT%H:%M:%SZ') AS time, upper(regexp_extract(line, {_FORM}, 2)) AS level, regexp_extract(regexp_extract(line, {_FORM}, 3), '[^.]*$') AS class_name"
#: Some lines without milliseconds, without a dash after the logger, or with a month that there is not.
_VARIED = "varied AS (SELECT file, line_no, CASE line_no % 4 WHEN 1 THEN regexp_replace(line, '\\.[0-9]{3} ', ' ') WHEN 2 THEN replace(line, ' - ', ' ') WHEN 3 THEN replace(line, '2024-01-1', '2024-13-1') ELSE line END AS line FROM log_lines)"
_CARRIED = f"carried AS (SELECT component, file, line_no, line, last_value({_TS} IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS tm FROM log_lines)"
_TIMED = f"{_CARRIED}, timed AS (SELECT * FROM carried WHERE tm IS NOT NULL AND strftime(tm, '%H:%M') BETWEEN '08:15' AND '17:45')"


@query("flt_time_hhmm", f"{W}, {_TIMED} SELECT file, line_no, line FROM timed")
def _(t):
    return L.in_time(t.log_lines(), "8:15", "17:45").select("file", "line_no", "line")


@query("win_carry_forward", f"{W}, {_CARRIED} SELECT file, line_no, strftime(tm, '%Y-%m-%d %H:%M:%S.%g') AS carried FROM carried")
def _(t):
    return L.with_carried_time(t.log_lines()).select("file", "line_no", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSS").alias("carried"))


@query("flt_hhmm_parse", "SELECT event_id, printf('%d:%02d', event_id % 26, event_id % 62) AS given, CASE WHEN event_id % 26 < 24 AND event_id % 62 < 60 THEN printf('%02d:%02d', event_id % 26, event_id % 62) END AS parsed FROM events")
def _(t):
    given = F.format_string("%d:%02d", c("event_id") % 26, c("event_id") % 62)
    return t.events.select("event_id", given.alias("given"), L.hhmm_of(given).alias("parsed"))


@query("flt_include", f"{W} SELECT file, line_no FROM log_lines WHERE contains(lower(line), 'error')")
def _(t):
    return L.including(t.log_lines(), "ERROR").select("file", "line_no")


@query("flt_exclude", f"{W} SELECT file, line_no FROM log_lines WHERE NOT contains(lower(line), 'info')")
def _(t):
    return L.excluding(t.log_lines(), "Info").select("file", "line_no")


@query("flt_loki_regex", f"{W} SELECT file, line_no FROM log_lines WHERE contains(lower(line), 'v=7')")
def _(t):
    return t.log_lines().where(c("line").rlike("(?i)\\Qv=7\\E")).select("file", "line_no")


@query("flt_loki_selector", f"{W} SELECT file, count(*) AS n FROM log_lines WHERE component = 'app' AND file = 'app-20240105000000000.log' GROUP BY file")
def _(t):
    return t.log_lines().where("component = 'app' AND file = 'app-20240105000000000.log'").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("dt_log_ts", f"{W} SELECT file, line_no, epoch_ms({_TS}) AS ms FROM log_lines")
def _(t):
    return t.log_lines().select("file", "line_no", F.unix_millis(L.line_time(c("line"))).alias("ms"))


def _varied(t):
    k, line = c("line_no") % 4, c("line")
    return t.log_lines().withColumn("line", F.when(k == 1, F.regexp_replace(line, r"\.[0-9]{3} ", " ")).when(k == 2, F.replace(line, F.lit(" - "), F.lit(" "))).when(k == 3, F.replace(line, F.lit("2024-01-1"), F.lit("2024-13-1"))).otherwise(line))


@query("dt_log_parse", f"{W}, {_VARIED} SELECT file, line_no, {_PARTS} FROM varied WHERE {_IS_ENTRY}")
def _(t):
    return L.entries(_varied(t), "file", "line_no")


@query("prj_privacy", f"{W}, {_VARIED} SELECT {_PARTS} FROM varied WHERE {_IS_ENTRY}")
def _(t):
    return L.entries(_varied(t))


_NAMES = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'oms-' || strftime(ts, '%Y%m%d%H%M%S') || '123.log' WHEN 1 THEN 'oms-x-' || strftime(ts, '%Y%m%d%H%M%S') || '000.log' WHEN 2 THEN 'oms-' || strftime(ts, '%Y%m%d') || '.log.gz' ELSE 'readme.log' END AS name FROM events"


def _names(t):
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    k = c("event_id") % 4
    name = F.when(k == 0, F.concat(F.lit("oms-"), stamp, F.lit("123.log"))).when(k == 1, F.concat(F.lit("oms-x-"), stamp, F.lit("000.log"))).when(k == 2, F.concat(F.lit("oms-"), F.date_format("ts", "yyyyMMdd"), F.lit(".log.gz"))).otherwise("readme.log")
    return t.events.select("event_id", name.alias("name"))


@query("src_log_components", rf"WITH n AS ({_NAMES}) SELECT DISTINCT regexp_extract(name, '^(.+)-([0-9]{{17}})\.log$', 1) AS component FROM n WHERE regexp_matches(name, '^(.+)-([0-9]{{17}})\.log$')")
def _(t):
    return _names(t).where(c("name").rlike(L.FILE)).select(F.regexp_extract("name", L.FILE, 1).alias("component")).distinct()


@query("src_log_component_files", f"WITH n AS ({_NAMES}) SELECT event_id, name FROM n WHERE starts_with(name, 'oms-')")
def _(t):
    return _names(t).where(c("name").startswith("oms-")).select("event_id", "name")


@query("src_log_list", f"{W} SELECT file, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes FROM log_lines GROUP BY file")
def _(t):
    # Written as files and listed by name with their sizes; contents aren't read.
    path = new_path(t.spark, "logs")
    t.log_lines().repartition("file").select("file", "line").write.partitionBy("file").text(path)
    listed = files.list_files(t.spark, path)
    return listed.groupBy(F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file")).agg(F.sum("bytes").alias("bytes")).orderBy("file")


_FILE_TS = "try_strptime(left(nullif(regexp_extract(name, '([0-9]{17})', 1), ''), 14), '%Y%m%d%H%M%S')"


@query("dt_file_ts", f"WITH n AS ({_NAMES}) SELECT event_id, epoch({_FILE_TS})::BIGINT AS s FROM n")
def _(t):
    return _names(t).select("event_id", F.unix_timestamp(L.file_time(c("name"))).alias("s"))


@query("dt_file_prune", f"WITH n AS ({_NAMES}), f AS (SELECT event_id, {_FILE_TS} AS tm FROM n) SELECT event_id, tm IS NULL OR (tm <= TIMESTAMP '2024-01-10 12:00:00' AND tm >= TIMESTAMP '2024-01-08 03:00:00') AS kept FROM f")
def _(t):
    at = lambda x: F.lit(x).cast("timestamp")
    return _names(t).select("event_id", L.file_kept(L.file_time(c("name")), at("2024-01-08 06:00:00"), at("2024-01-10 12:00:00")).alias("kept"))


@query("dt_flexible", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS s FROM events")
def _(t):
    k = c("event_id") % 4
    given = F.when(k == 0, F.date_format("ts", "yyyyMMddHHmmss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return t.events.select("event_id", F.unix_timestamp(L.flexible_time(given)).alias("s"))


@query("dt_hhmm", "SELECT event_id, strftime(ts, '%H:%M') AS hhmm FROM events")
def _(t):
    return t.events.select("event_id", F.date_format("ts", "HH:mm").alias("hhmm"))


@query("dt_fmt", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.000' AS start, strftime(ts, '%Y-%m-%d %H:%M:%S') || '.999' AS stop, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def _(t):
    second = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return t.events.select("event_id", F.concat(second, F.lit(".000")).alias("start"), F.concat(second, F.lit(".999")).alias("stop"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


_WIN = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 6 HOUR ELSE ts - INTERVAL 3 HOUR END AS a, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts + INTERVAL 1 HOUR END AS b FROM events"


@query("dt_incident_window", f"WITH w AS ({_WIN}) SELECT event_id, epoch_us(a)::BIGINT AS start_us, epoch_us(b)::BIGINT AS end_us, epoch_us(a - INTERVAL 3 HOUR)::BIGINT AS cutoff_us FROM w")
def _(t):
    incident = F.when(c("event_id") % 3 != 0, c("ts").cast("timestamp"))
    w = L.incident_window(incident, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return t.events.select("event_id", *[F.unix_micros(x).alias(f"{n}_us") for n, x in w.items()])


@query("dt_epoch_ns", f"{W} SELECT file, line_no, epoch_us({_TS}) * 1000 AS ns FROM log_lines")
def _(t):
    return t.log_lines().select("file", "line_no", (F.unix_micros(L.line_time(c("line"))) * 1000).alias("ns"))


@query("agg_window_minmax", "SELECT event_type, epoch_us(min(ts))::BIGINT AS start_us, epoch_us(max(ts))::BIGINT AS end_us FROM events GROUP BY event_type")
def _(t):
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    return t.events.groupBy("event_type").agg(us(F.min("ts")).alias("start_us"), us(F.max("ts")).alias("end_us"))


@query("lim_tail", f"{W}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no DESC) AS k FROM log_lines) SELECT file, line_no, line FROM n WHERE k <= 25")
def _(t):
    return L.tail(t.log_lines(), 25).select("file", "line_no", "line")


_HITS = f"hits AS (SELECT file, line_no, {_PARTS} FROM log_lines WHERE {_IS_ENTRY})"
_FOLD = "runs AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY line_no) AS run FROM (SELECT *, CASE WHEN lag(level) OVER w IS NOT DISTINCT FROM level AND lag(class_name) OVER w IS NOT DISTINCT FROM class_name AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY {k} ORDER BY line_no)))"
_EVENT = "min_by(time, line_no) || ' [' || any_value(level) || '][' || any_value(class_name) || ']' || CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ' times)' ELSE '' END AS event"


def _hits(t):
    return L.entries(t.log_lines(), "file", "line_no")


@query("agg_fold_runs", f"{W}, {_HITS}, {_FOLD.format(k='file')} SELECT file, run::BIGINT AS run, count(*) AS n, {_EVENT} FROM runs GROUP BY file, run")
def _(t):
    return L.folded(_hits(t), ["file"], "line_no").select("file", "run", "n", "event")


@query("win_runs", f"{W}, {_HITS}, {_FOLD.format(k='file')} SELECT file, max(run)::BIGINT AS runs FROM runs GROUP BY file")
def _(t):
    return L.folded(_hits(t), ["file"], "line_no").groupBy("file").agg(F.max("run").alias("runs"))


_TASKS = "tasks AS (SELECT 'app-' || strftime(DATE '2024-01-01' + i::INT, '%Y%m%d') || '000000000.log' AS file, kw FROM range(0, 30) r(i), (VALUES ('error'), ('signup'), ('v=9')) k(kw))"


def _tasks(t):
    files = t.spark.range(30).select(F.concat(F.lit("app-"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), c("id").cast("int")), "yyyyMMdd"), F.lit("000000000.log")).alias("file"))
    return files.select("file", F.explode(F.array(F.lit("error"), F.lit("signup"), F.lit("v=9"))).alias("kw"))


@query("jn_task_lines", f"{W}, {_TASKS} SELECT l.file, kw, line_no FROM log_lines l JOIN tasks t ON l.file = t.file AND contains(lower(line), kw)")
def _(t):
    return L.keyword_hits(t.log_lines(), _tasks(t)).select("file", "kw", "line_no")


@query("flow_scan", f"{W}, {_TIMED}, {_TASKS}, hits AS (SELECT l.file, kw, line_no, {_PARTS} FROM timed l JOIN tasks t ON l.file = t.file AND contains(lower(line), kw) AND {_IS_ENTRY}), {_FOLD.format(k='file, kw')} SELECT file, kw, run::BIGINT AS run, {_EVENT} FROM runs GROUP BY file, kw, run")
def _(t):
    # One scan for all keywords; the message is dropped before anything is grouped.
    met = keep(L.keyword_hits(L.in_time(t.log_lines(), "8:15", "17:45"), _tasks(t)), "hits")
    return L.folded(L.entries(met, "file", "kw", "line_no"), ["file", "kw"], "line_no").select("file", "kw", "run", "event")


_CAT_SQL = "cat AS (SELECT ['prod', 'prod', 'uat', 'local'][s_suppkey % 4 + 1] AS environment, CASE WHEN s_suppkey % 3 = 0 THEN 'loki' ELSE 'logtail' END AS type, ['oms,fx', 'risk', 'oms', 'fx,bond', 'oms,risk'][s_suppkey % 5 + 1] AS tags, 'https://logs/' || s_suppkey AS base_url, s_suppkey AS pos FROM supplier)"
_FIRST_SQL = f"{_CAT_SQL}, firsts AS (SELECT environment, type, tag, min_by(base_url, pos) AS base_url FROM (SELECT environment, type, unnest(string_split(tags, ',')) AS tag, base_url, pos FROM cat) GROUP BY ALL)"


def _catalog(t):
    """A log server for each supplier."""
    k = c("s_suppkey")
    of = lambda by, *xs: F.get(F.array(*map(F.lit, xs)), (k % by).cast("int"))
    return t.supplier.select(of(4, "prod", "prod", "uat", "local").alias("environment"), F.when(k % 3 == 0, "loki").otherwise("logtail").alias("type"), of(5, "oms,fx", "risk", "oms", "fx,bond", "oms,risk").alias("tags"), F.concat(F.lit("https://logs/"), k).alias("base_url"), k.alias("pos"))


@query("src_log_catalog", f"WITH {_CAT_SQL} SELECT environment, type, string_split(tags, ',') AS tags, base_url, 'logs ' || pos AS summary FROM cat")
def _(t):
    # Written as a file with bars between its columns, and read as the catalogue is.
    path = new_path(t.spark, "catalogue")
    _catalog(t).select("environment", "type", "tags", "base_url", F.concat(F.lit("logs "), "pos").alias("summary")).write.option("sep", "|").option("header", True).csv(path)
    return files.read_log_catalogue(t.spark, path)


@query("flt_catalog", f"WITH {_CAT_SQL} SELECT base_url FROM cat WHERE environment = 'prod' AND type = 'logtail' AND list_contains(string_split(tags, ','), 'fx') ORDER BY pos LIMIT 1")
def _(t):
    return _catalog(t).where((c("environment") == "prod") & (c("type") == "logtail") & F.array_contains(F.split("tags", ","), "fx")).orderBy("pos").limit(1).select("base_url")


@query("flow_discover_logs", f"WITH {_CAT_SQL}, tagged AS (SELECT base_url, unnest(string_split(tags, ',')) AS prefix FROM cat WHERE environment = 'prod' AND type = 'logtail'), n AS ({_NAMES}) SELECT base_url, prefix, count(*) AS files FROM tagged JOIN n ON starts_with(name, prefix || '-') GROUP BY ALL")
def _(t):
    tagged = _catalog(t).where("environment = 'prod' AND type = 'logtail'").select("base_url", F.explode(F.split("tags", ",")).alias("prefix"))
    # A file belongs to a tag if its first part, up to a dash, is the tag; files are counted by it before servers are joined.
    named = _names(t).where(F.contains("name", F.lit("-"))).groupBy(F.substring_index("name", "-", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("files"))
    return named.join(tagged, "prefix").select("base_url", "prefix", "files")


_PLAN_SQL = "p AS (SELECT DISTINCT ['prod', 'uat', 'local'][user_id % 3 + 1] AS environment, CASE WHEN event_id % 2 = 0 THEN 'loki' ELSE 'logtail' END AS type, ['oms', 'fx', 'none'][event_id % 3 + 1] AS tag FROM events)"


@query("jn_plan_sources", f"WITH {_FIRST_SQL}, {_PLAN_SQL} SELECT environment, type, tag, base_url FROM p LEFT JOIN firsts USING (environment, type, tag)")
def _(t):
    of = lambda x, *xs: F.get(F.array(*map(F.lit, xs)), (x % len(xs)).cast("int"))
    plan = t.events.select(of(c("user_id"), "prod", "uat", "local").alias("environment"), F.when(c("event_id") % 2 == 0, "loki").otherwise("logtail").alias("type"), of(c("event_id"), "oms", "fx", "none").alias("tag")).distinct()
    return plan.join(L.first_servers(_catalog(t)), ["environment", "type", "tag"], "left")


_BY_LISTING = f"SELECT 'listing' AS variant, event_id, name, kw, '2024-01-10 09:00:00.000' AS start, '2024-01-10 13:00:00.999' AS stop FROM k, (VALUES ('timeout'), ('reject')) v(kw)"
_SOURCES_SQL = """s AS (SELECT user_id AS plan, event_id, ['loki', 'logtail', 'odd'][event_id % 3 + 1] AS type, CASE WHEN event_id % 7 = 0 THEN [] ELSE [['oms', 'fx', 'none'][event_id % 5 % 3 + 1], 'risk'] END AS tags, CASE WHEN event_id % 4 > 0 AND user_id % 10 > 0 THEN ts END AS a, CASE WHEN event_id % 5 > 0 AND user_id % 10 > 1 THEN ts + INTERVAL 1 HOUR END AS b, [event_type, 'kw' || event_id % 3] AS kws FROM events),
g AS (SELECT plan, coalesce(min(a), TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 HOUR) AS ga, max(b) AS gb FROM s GROUP BY plan),
w AS (SELECT s.*, coalesce(a, ga) AS wa, coalesce(b, gb, ga + INTERVAL 7 HOUR) AS wb FROM s JOIN g USING (plan) WHERE len(tags) > 0),
lk AS (SELECT min_by(base_url, pos) AS base_url FROM cat WHERE environment = 'prod' AND type = 'loki'),
r AS (SELECT event_id, base_url, kws, wa, wb FROM (SELECT *, unnest(tags) AS tag FROM w WHERE type = 'logtail') x JOIN firsts f ON f.environment = 'prod' AND f.type = 'logtail' AND f.tag = x.tag UNION ALL SELECT event_id, base_url, kws, wa, wb FROM w, lk WHERE type = 'loki' AND base_url IS NOT NULL)"""


@query("flow_plan", f"WITH {_FIRST_SQL}, n AS ({_NAMES}), f AS (SELECT event_id, name, {_FILE_TS} AS tm FROM n), k AS (SELECT * FROM f WHERE starts_with(name, 'oms-') AND (tm IS NULL OR (tm <= TIMESTAMP '2024-01-10 13:00:00' AND tm >= TIMESTAMP '2024-01-10 06:00:00'))), {_SOURCES_SQL} {_BY_LISTING} UNION ALL SELECT 'catalogue', event_id, base_url, unnest(kws), strftime(wa, '%Y-%m-%d %H:%M:%S') || '.000', strftime(wb, '%Y-%m-%d %H:%M:%S') || '.999' FROM r")
def _(t):
    # By the files that were listed, with the window around an incident; and by the servers in the catalogue, with each source's window or its plan's.
    incident = F.lit("2024-01-10 12:00:00").cast("timestamp")
    w = L.incident_window(incident, incident)
    kept = _names(t).where(c("name").startswith("oms-")).where(L.file_kept(L.file_time(c("name")), w["start"], w["end"]))
    stamp = lambda x, ms: F.concat(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), F.lit(ms))
    listed = kept.select(F.lit("listing").alias("variant"), "event_id", "name", F.explode(F.array(F.lit("timeout"), F.lit("reject"))).alias("kw"), stamp(w["start"], ".000").alias("start"), stamp(w["end"], ".999").alias("stop"))
    i, u, ts = c("event_id"), c("user_id"), c("ts").cast("timestamp")
    of = lambda x, *xs: F.get(F.array(*map(F.lit, xs)), (x % len(xs)).cast("int"))
    sources = t.events.select(
        u.alias("plan"), "event_id", F.lit("prod").alias("environment"), of(i, "loki", "logtail", "odd").alias("type"), F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(of(i % 5, "oms", "fx", "none"), F.lit("risk"))).alias("tags"),
        F.when((i % 4 > 0) & (u % 10 > 0), ts).alias("start"), F.when((i % 5 > 0) & (u % 10 > 1), ts + F.expr("INTERVAL 1 HOUR")).alias("stop"), F.array("event_type", F.concat(F.lit("kw"), i % 3)).alias("keywords"),
    )
    planned = L.planned(sources, _catalog(t), F.lit("2024-01-31 00:00:00").cast("timestamp"))
    return listed.unionByName(planned.select(F.lit("catalogue").alias("variant"), "event_id", c("base_url").alias("name"), F.explode("keywords").alias("kw"), stamp(c("start"), ".000").alias("start"), stamp(c("stop"), ".999").alias("stop")))


@query("agg_kw_union", "WITH k AS (SELECT lower(event_type) AS kw, min(event_id) AS pos FROM events GROUP BY 1) SELECT kw, row_number() OVER (ORDER BY pos) AS n FROM k")
def _(t):
    first = t.events.groupBy(F.lower("event_type").alias("kw")).agg(F.min("event_id").alias("pos"))
    return first.select("kw", F.row_number().over(Window.orderBy("pos")).alias("n"))


@query("src_log_read", f"{W} SELECT component, file, line_no, line FROM log_lines")
def _(t):
    # Written as one text file for each log and read in ranges of bytes, with the lines' numbers.
    path = new_path(t.spark, "logs")
    t.log_lines().repartition("file").sortWithinPartitions("file", "line_no").select("component", "file", "line").write.partitionBy("component", "file").text(path)
    named = lambda x: F.regexp_extract("path", f"{x}=([^/]+)/", 1).alias(x)
    return files.read_numbered_lines(t.spark, path, 4 << 20).select(named("component"), named("file"), "line_no", "line")


@query("src_loki_range", f"{W}, k AS (SELECT file, line_no, line, {_TS} AS tm FROM log_lines WHERE contains(lower(line), 'error')), n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY tm, line_no) AS k FROM k WHERE tm BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00') SELECT file, line_no, line FROM n WHERE k <= 2000")
def _(t):
    at = lambda x: F.lit(x).cast("timestamp")
    hits = L.including(t.log_lines(), "error").withColumn("at", L.line_time(c("line"))).where(c("at").between(at("2024-01-05 00:00:00"), at("2024-01-15 00:00:00")))
    ranked = hits.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("at", "line_no")))
    return ranked.where("k <= 2000").select("file", "line_no", "line")


@query("sink_loki_push", f"{W} SELECT printf('{{\"job\":\"logs\",\"component\":\"%s\",\"filename\":\"%s\"}}', component, file) AS labels, (epoch_us({_TS}) * 1000)::VARCHAR AS ns, trim(line) AS line FROM log_lines WHERE trim(line) <> ''")
def _(t):
    kept = t.log_lines().select("component", "file", F.trim("line").alias("line"), (F.unix_micros(L.line_time(c("line"))) * 1000).cast("string").alias("ns")).where("line <> ''")
    return kept.select(F.to_json(F.create_map(F.lit("job"), F.lit("logs"), F.lit("component"), "component", F.lit("filename"), "file")).alias("labels"), "ns", "line")
