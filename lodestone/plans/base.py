"""Registration of queries, and the tables and derived views that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
#: The question of the ranking queries.
ASKED = "ci der die und les src7"


class Tables:
    """The driver's tables by attribute, and views over them by method."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ("documents", "pages", "customer"):  # long rows, or rows that are made many of
            return read_table(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def doc_meta(self) -> DataFrame:
        """Documents as stored metadata: id, title (start of the first line), type, tags, summary, last_updated, version, url, referring questions."""
        first = F.substring_index("text", "\n", 1)
        return self.documents.select(
            F.col("doc_id").cast("string").alias("id"),
            F.left(first, F.lit(60)).alias("title"),
            F.col("source").alias("type"),
            F.array("lang", "source").alias("tags"),
            F.left("text", F.lit(200)).alias("summary"),
            F.format_string("2024-%02d-%02d", F.pmod("doc_id", F.lit(12)) + 1, F.pmod("doc_id", F.lit(28)) + 1).alias("last_updated"),
            (F.pmod("doc_id", F.lit(5)) + 1).cast("int").alias("version"),
            F.concat(F.lit("https://wiki.example.com/pages/"), F.col("doc_id").cast("string")).alias("url"),
            F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(ASKED)))
            .when(F.col("doc_id") % 4 == 1, F.array(F.lit("Die und"), "lang"))
            .when(F.col("doc_id") % 4 == 2, F.array(F.concat("source", F.lit(" how"))))
            .otherwise(F.array().cast("array<string>"))
            .alias("referenced"),
        )

    def log_lines(self) -> DataFrame:
        """Events as lines of daily log files; some lines go on from the one before and carry no time."""
        kind = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
        day = F.date_format("ts", "yyyyMMdd")
        line = F.when(F.col("event_id") % 7 == 3, F.concat(F.lit("  at com.app."), F.initcap("event_type"), F.lit(".handle"))).otherwise(
            F.format_string("%s %-5s [t-%d] com.app.%s - v=%d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), kind, F.col("user_id"), F.initcap("event_type"), F.floor("value"))
        )
        by_day = Window.partitionBy(day).orderBy("ts", "event_id")
        return self.events.select(F.lit("app").alias("component"), F.concat(F.lit("app-"), day, F.lit("000000000.log")).alias("file"), F.row_number().over(by_day).cast("long").alias("line_no"), line.alias("line"))


#: The same views in DuckDB.
DOC_META_SQL = f"""doc_meta AS (SELECT doc_id::VARCHAR AS id, left(string_split(text, chr(10))[1], 60) AS title, source AS type, [lang, source] AS tags, left(text, 200) AS summary,
 printf('2024-%02d-%02d', (doc_id % 12) + 1, (doc_id % 28) + 1) AS last_updated, (doc_id % 5 + 1)::INT AS version, 'https://wiki.example.com/pages/' || doc_id AS url,
 CASE doc_id % 4 WHEN 0 THEN ['{ASKED}'] WHEN 1 THEN ['Die und', lang] WHEN 2 THEN [source || ' how'] ELSE []::VARCHAR[] END AS referenced FROM documents)"""
LOG_LINES_SQL = """log_lines AS (SELECT 'app' AS component, 'app-' || strftime(ts, '%Y%m%d') || '000000000.log' AS file, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY ts, event_id) AS line_no,
 CASE WHEN event_id % 7 = 3 THEN '  at com.app.' || upper(event_type[1]) || event_type[2:] || '.handle'
 ELSE printf('%s %-5s [t-%d] com.app.%s - v=%d', strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END, user_id, upper(event_type[1]) || event_type[2:], floor(value)::BIGINT) END AS line FROM events)"""

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under an operator's id, with its SQL where there is any."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return put
