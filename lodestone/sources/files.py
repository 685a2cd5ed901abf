"""Stored documents, prompts and logs as files, read and written by Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.ranges import RANGE, TextRanges

META = "id string, title string, type string, author string, summary string, tags array<string>, version int, last_updated string, url string"
_META = [field.split()[0] for field in META.split(", ")]


def write_files(rows: DataFrame, path: str) -> None:
    """Write ``body`` of each row as the file ``name`` below a folder that all executors share.

    Tasks write beside the name and move, so a task that is tried again leaves whole files; of
    rows with one name the last to be written stays. A task makes the folders that it needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = fs.FileSystem.from_uri(path)
        files.create_dir(top, recursive=True)
        n, made = 0, ""
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{top}/{name}"
                if "/" in name and made != (made := place.rpartition("/")[0]):
                    files.create_dir(made, recursive=True)
                aside = f"{place}.{uuid.uuid4().hex}.tmp"
                with files.open_output_stream(aside) as out:
                    out.write((body or "").encode("utf-8", "replace"))
                files.move(aside, place)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.select(F.col("name").cast("string"), F.col("body").cast("string")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_files(spark: SparkSession, path: str, *ends: str) -> DataFrame:
    """(path, content): all files below a folder whose names end with one of ``ends``; hidden ones are left out, as Spark's readers do.

    The entries of the folder itself are listed by one task and dealt out; whoever gets a folder
    walks it and reads what is in it. So neither a list of all files nor a task's share of them
    goes through the driver, which would plan a split for each. A store in subfolders is listed
    in parallel too. Where pyarrow doesn't know the file system, Spark's reader is used.
    """
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, OSError):
        found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{{{','.join(ends)}}}").text(path, wholetext=True)
        return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    shown = lambda name: not name.startswith(("_", "."))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = fs.FileSystem.from_uri(path)
        for _ in batches:
            entries = files.get_file_info(fs.FileSelector(at))
            for i in range(0, len(entries), 10_000):
                part = [e for e in entries[i : i + 10_000] if shown(e.base_name) and (e.type == fs.FileType.Directory or e.base_name.endswith(ends))]
                yield pa.RecordBatch.from_arrays([pa.array([e.path for e in part], pa.string()), pa.array([e.type == fs.FileType.Directory for e in part], pa.bool_())], names=["path", "folder"])

    def below(files: fs.FileSystem, folder: str) -> Iterator[str]:
        for e in files.get_file_info(fs.FileSelector(folder)):
            if shown(e.base_name) and e.type == fs.FileType.Directory:
                yield from below(files, e.path)
            elif shown(e.base_name) and e.base_name.endswith(ends):
                yield e.path

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(path)
        names, bodies, size = [], [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])
        for batch in batches:
            for entry, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for name in below(files, entry) if folder else (entry,):
                    with files.open_input_stream(name) as stream:
                        bodies.append(stream.read())
                    names.append(name)
                    size += len(bodies[-1])
                    if size > 4_000_000 or len(names) >= 5000:
                        yield out()
                        names, bodies, size = [], [], 0
        if names:
            yield out()

    entries = spark.range(0, 1, 1, 1).mapInArrow(top, "path string, folder boolean")
    # As many parts as asked for: sizes of names say nothing of those of files.
    dealt = entries.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    return dealt.mapInArrow(read, "path string, content binary").select("path", F.col("content").cast("string").alias("content"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of a store: ``<id>/metadata.json`` wins over loose ``<id>.json``; what can't be read is left out."""
    text, bad = F.ltrim("content", F.lit("\ufeff \t\r\n")), {"columnNameOfCorruptRecord": "_bad"}
    one, listed = F.from_json(text, f"{META}, _bad string", bad), F.from_json(F.concat(F.lit('{"a":'), text, F.lit("}")), f"a array<struct<{META}>>, _bad string", bad)
    alone = F.when(one["_bad"].isNull(), F.array(F.struct(*[one[n].alias(n) for n in _META])))
    said = F.when(text.startswith("["), F.when(listed["_bad"].isNull(), listed["a"])).otherwise(alone)
    rows = read_files(spark, path, ".json").select(F.col("path").alias("__path"), F.inline(said)).where("id IS NOT NULL")
    best = Window.partitionBy("id").orderBy(F.col("__path").endswith("/metadata.json").desc(), F.col("__path").desc())
    return rows.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n", "__path")


def read_metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of a store kept as one document a line, in files that tasks share; what can't be read is left out."""
    rows = spark.read.schema(META + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True).json(path)
    return rows.where("_bad IS NULL AND id IS NOT NULL").drop("_bad")


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(id, content): ``<id>/content.md``, else ``<id>.md``, else ``<id>.txt``."""
    rows = read_files(spark, path, ".md", ".txt").select("content", F.col("path").alias("p"))
    own = F.regexp_extract("p", r"([^/]+)/content\.md$", 1)
    named = F.when(own != "", F.struct(own.alias("id"), F.lit(0).alias("o"))).otherwise(F.struct(F.regexp_extract("p", r"([^/]+)\.(?:md|txt)$", 1).alias("id"), F.when(F.col("p").endswith(".md"), 1).otherwise(2).alias("o")))
    rows = rows.select("content", named.alias("k")).select("content", "k.id", "k.o")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("o"))).where("n = 1").select("id", "content")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of all files below a folder; what is in them isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))


def read_log_catalogue(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("environment string, type string, tags string, base_url string, summary string").option("sep", "|").option("header", True).csv(path)
    return rows.withColumn("tags", F.split("tags", ","))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of ``*.log`` files; bytes that are no UTF-8 are replaced. A task holds one file (rolled at 50 MB)."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    text = F.col("content").cast("string")
    lines = rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    return lines.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), "line").where("line <> ''")


def read_numbered_lines(spark: SparkSession, path: str, size: int = RANGE, suffix: str = "") -> DataFrame:
    """(path, line_no, line) of a file or of all files below a folder, in ranges of ``size`` bytes.

    The lines of each range are counted first; the numbers of those in the ranges before are
    joined to the lines, a row for each range.
    """
    spark.dataSource.register(TextRanges)
    rows = spark.read.format("text_ranges").options(path=path, range=str(size), suffix=suffix).load()
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, ["path", "start"]).select("path", (F.col("before") + F.col("pos") + 1).alias("line_no"), "line")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(component, file, line) of logs in folders by component; tasks share large files, so lines have no number."""
    rows = spark.read.text(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1))
    return rows.select("component", "file", F.col("value").alias("line")).where("line <> ''")


def prompt_text(spark: SparkSession, path: str, most: int, glob: str = "*.md") -> str:
    """All files below a folder by path, trimmed, joined, and cut to ``most`` characters: a prompt's context.

    Only the first files are opened: as many, by their sizes, as may fill the context, and twice
    as many again if blanks have left it short.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length").where("length > 0")
    wanted = most
    while True:
        # A character has four bytes at most and each file one at least, so a bounded number of names is looked at.
        first = listed.orderBy("path").limit(wanted).collect()
        taken, size = [], 0
        for r in first:
            if size >= 4 * wanted:
                break
            taken.append(r.path)
            size += r.length
        if not taken:
            return ""
        rows = spark.read.text(taken, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.left(F.btrim("value", F.lit(" \t\r\n")), F.lit(most)).alias("v")).where("v <> ''")
        parts = [v for _, v in sorted((r.p, r.v) for r in rows.collect())]
        text = "\n\n".join(parts)[:most]
        if len(text) >= most or (len(taken) == len(first) and len(first) < wanted):
            return text
        wanted *= 2
