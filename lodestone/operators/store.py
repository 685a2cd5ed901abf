"""The document store as tables: versions, updates, references and patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as X
from lodestone.scratch import new_path

c = F.col
# Characters of a partial content, the note after it, and characters of an issue that is quoted.
PARTIAL, QUOTED = 600, 800
PARTIAL_NOTE = "[Note]: This is partial content. If the partial content is likely related to the user query, MUST read full content using mode 'id_2_content' with the same doc ID."


def upsert(store: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``changes`` in place of the store's rows with their key, and all others."""
    return store.join(changes.select(key).distinct(), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def without(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def newest(rows: DataFrame, key: str, priority: str) -> DataFrame:
    """One row for each key, that of the highest priority; of equals the greatest as JSON."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(priority), F.desc(F.to_json(F.struct(*[c(f"`{x}`") for x in rows.columns])))))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def stale(stored: DataFrame, remote: DataFrame, key: str = "id") -> DataFrame:
    """Remote rows that the store lacks or has in an older version."""
    own = stored.select(key, c("version").alias("__own"))
    return remote.join(own, key, "left").where("__own IS NULL OR __own < version").drop("__own")


def put(stored: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """Each update with its state: accepted if its version is the next, a conflict otherwise, missing without a page."""
    own = stored.select(key, c("version").alias("current"))
    state = F.when(c("current").isNull(), "missing").when(c("version") == c("current") + 1, "accepted").otherwise("conflict")
    return updates.join(own, key, "left").withColumn("state", state)


def normalised(meta: DataFrame) -> DataFrame:
    """Defaults for what is missing; null and empty types are wiki pages."""
    text = lambda n: F.coalesce(c(n), F.lit("")).alias(n)
    return meta.select("id", text("title"), F.coalesce(F.nullif(c("type"), F.lit("")), F.lit("confluence")).alias("type"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), text("summary"), text("last_updated"), F.coalesce("version", F.lit(0)).alias("version"), text("url"))


def patched(stored: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Summary and tags are replaced even by nothing; the type stays where the patch has none."""
    p = patch.select(key, c("summary").alias("__s"), c("tags").alias("__t"), c("type").alias("__k"), F.lit(True).alias("__hit"))
    hit = F.coalesce(c("__hit"), F.lit(False))
    met = stored.join(p, key, "left")
    return met.withColumns({"summary": F.when(hit, F.coalesce("__s", F.lit(""))).otherwise(c("summary")), "tags": F.when(hit, F.coalesce("__t", F.array().cast("array<string>"))).otherwise(c("tags")), "type": F.when(hit & (F.coalesce("__k", F.lit("")) != ""), c("__k")).otherwise(c("type"))}).select(*stored.columns)


def related(targets: DataFrame, store: DataFrame) -> DataFrame:
    """Targets, and pages one link away that aren't targets, with a mark on those."""
    linked = targets.select(F.explode("related").alias("id")).distinct().join(targets.select("id"), "id", "left_anti")
    return targets.select("id", F.lit(False).alias("traversed")).unionByName(store.select("id").join(linked, "id", "left_semi").select("id", F.lit(True).alias("traversed")))


def expanded(keys: DataFrame, store: DataFrame) -> DataFrame:
    """Keys (doc_id, key) with the document that each means: by issue key, by a title that begins with it, or by id.

    Three joins by equality; of several documents the one with the least id is quoted.
    """
    upper = lambda x: F.upper(F.coalesce(x, F.lit("")))
    named = [upper(c("issue_key")), F.when(F.contains("title", F.lit(":")), F.substring_index(upper(c("title")), ":", 1)), upper(c("id"))]
    arms = store.select("id", "title", "content", F.explode(F.array_compact(F.array_distinct(F.array(*named)))).alias("key"))
    found = arms.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("title", "content"), "id").alias("d"))
    quoted = F.concat(F.lit("["), "key", F.lit("] "), F.coalesce("d.title", F.lit("")), F.lit("\n"), F.left(F.coalesce("d.content", F.lit("")), F.lit(QUOTED)))
    return keys.distinct().join(found, "key").select("doc_id", "key", quoted.alias("content"))


def resolved(asked: DataFrame, store: DataFrame) -> DataFrame:
    """``asked`` (doc_id, asked, link) with ``found``: the document by id or issue key, else by the page id in the link."""
    arms = store.select("id", F.explode(F.array_compact(F.array_distinct(F.array(c("id"), F.upper("issue_key"))))).alias("name")).groupBy("name").agg(F.min("id").alias("by_name"))
    pages = store.select(c("id").alias("by_link"))
    page = F.nullif(F.regexp_extract(F.coalesce("link", F.lit("")), r"[?&]pageId=([0-9]+)", 1), F.lit(""))
    met = asked.join(arms, F.upper("asked") == c("name"), "left").withColumn("page", page).join(pages, c("page") == c("by_link"), "left")
    return met.select("doc_id", F.coalesce("by_name", "by_link").alias("found"))


def feedback_target(asked: DataFrame, store: DataFrame) -> DataFrame:
    """``asked`` with ``found``: the document whose id the ``target`` is, else that of the page id in it, else that of its address.

    Three joins by equality. Addresses are the same with and without a last slash; of several
    documents at one the least id is taken.
    """
    text = F.btrim(F.coalesce(c("target"), F.lit("")))
    by = asked.withColumns({"__text": text, "__page": F.nullif(X.link_page_id(text), F.lit("")), "__url": F.when(text.rlike("(?i)^https?://"), F.regexp_replace(text, "/$", ""))})
    ids = store.select("id").where("id <> ''").distinct()
    urls = store.select(F.regexp_replace(F.btrim("url"), "/$", "").alias("__url"), "id").where("__url <> ''").groupBy("__url").agg(F.min("id").alias("__by_url"))
    met = by.join(ids.select(c("id").alias("__by_id")), c("__text") == c("__by_id"), "left").join(ids.select(c("id").alias("__by_page")), c("__page") == c("__by_page"), "left").join(urls, "__url", "left")
    return met.select(*asked.columns, F.coalesce("__by_id", "__by_page", "__by_url").alias("found"))


def asked_of(feedback: DataFrame) -> DataFrame:
    """(kind, target, query, last_asked) of feedback rows (page_id, issue_id, link, secondary, query, at).

    The primary target of a row is its page, else its issue, else its link; each secondary one
    only gets the question. Rows without question or target name nothing.
    """
    trimmed = lambda x: F.nullif(F.btrim(F.coalesce(x, F.lit(""))), F.lit(""))
    first = F.coalesce(*[trimmed(c(n)) for n in ("page_id", "issue_id", "link")])
    kinds = F.array(F.struct(F.lit("primary").alias("kind"), F.array(first).alias("targets")), F.struct(F.lit("secondary").alias("kind"), F.transform(F.coalesce("secondary", F.array().cast("array<string>")), lambda x: trimmed(x)).alias("targets")))
    each = feedback.select("query", "at", F.inline(kinds)).select("kind", F.explode("targets").alias("target"), trimmed(c("query")).alias("query"), "at")
    return each.where("target IS NOT NULL AND query IS NOT NULL").groupBy("kind", "target", "query").agg(F.max("at").alias("last_asked"))


def modernised(raw: DataFrame) -> DataFrame:
    """Stored metadata (doc_id, metadata as JSON) of any age in the shape of today.

    Questions that refer to a document are a map of their times; they were a list, or one text
    parted by commas. Keywords are an object or nothing; tags and related pages are lists or
    empty; what is no text is the empty one. Metadata that are no object are as good as empty.
    """
    v = F.try_parse_json("metadata")
    at = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    kind_of = lambda path: F.coalesce(F.schema_of_variant(at(path, "variant")), F.lit(""))
    none = F.array().cast("array<string>")
    text = lambda name: F.when(kind_of(name) == "STRING", at(name, "string")).otherwise("")
    strings = lambda name: F.when(kind_of(name).startswith("ARRAY"), F.coalesce(at(name, "array<string>"), none)).otherwise(none)
    full = lambda xs: F.filter(F.array_distinct(F.transform(xs, lambda x: F.btrim(F.coalesce(x, F.lit("")), F.lit(" \t\r\n")))), lambda x: x != "")
    q = "referencedQueries"
    listed = F.when(kind_of(q).startswith("ARRAY"), full(at(q, "array<string>"))).when(kind_of(q) == "STRING", full(F.split(at(q, "string"), ",")))
    times = lambda x: F.filter(F.coalesce(F.try_variant_get(x, "$", "array<string>"), none), lambda s: s.isNotNull() & (s != ""))
    given = F.transform(F.map_entries(at(q, "map<string,variant>")), lambda e: F.struct(F.btrim(e["key"]).alias("key"), times(e["value"]).alias("value")))
    named = F.filter(given, lambda e: e["key"] != "")
    mapped = F.when(kind_of(q).startswith("OBJECT"), F.map_from_entries(named)).when(listed.isNotNull(), F.map_from_arrays(listed, F.transform(listed, lambda x: none))).otherwise(F.create_map().cast("map<string,array<string>>"))
    return raw.select(
        F.coalesce(at("id", "string"), c("doc_id").cast("string")).alias("id"), F.when(kind_of("keywords").startswith("OBJECT"), F.to_json(at("keywords", "variant"))).alias("keywords"), strings("tags").alias("tags"), mapped.alias("referenced"),
        text("summary").alias("summary"), text("feedback").alias("feedback"), text("knowledgeGraph").alias("knowledge_graph"), strings("relatedPages").alias("related"),
    )


def checked(store: DataFrame, ids: DataFrame) -> DataFrame:
    """(mode, id, part): what each of the five modes of a document check says of the documents asked for.

    ``store`` has id, title, type, tags, summary, url, related and content. The last mode adds
    pages one link away. Parts are rows, joined by the caller only if they are few.
    """
    asked = store.join(ids.distinct(), "id", "left_semi")
    head = F.concat(F.lit("### ["), "title", F.lit("] (ID: "), "id", F.lit(")\n"))
    partial = F.when(F.length("content") > PARTIAL, F.concat(F.left("content", F.lit(PARTIAL)), F.lit(f"...\n{PARTIAL_NOTE}"))).otherwise(c("content"))
    short = ["id", "title", "summary", "tags", "type", "url"]
    near = related(asked.select("id", "related"), store)
    graph = store.join(near, "id").select("id", F.to_json(F.struct(*short, F.lit("").alias("knowledgeGraph"), c("related").alias("relatedPages"), c("traversed").alias("_traversed"))).alias("part"))
    mode = lambda name, rows, part: rows.select(F.lit(name).alias("mode"), "id", part.alias("part"))
    return (
        mode("id_2_content", asked, F.concat(head, "content"))
        .unionByName(mode("id_2_metadata", asked, F.to_json(F.struct("id", "title", "type", "tags", "summary", "url", "related"))))
        .unionByName(mode("id_2_content_partial", asked.where("content <> ''"), F.concat(head, partial)))
        .unionByName(mode("id_2_metadata_4_summary", asked, F.to_json(F.struct(*short))))
        .unionByName(mode("id_2_metadata_4_summary_kg", graph, c("part")))
    )


def reached(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, depth) of a hierarchy, breadth first, until nothing new is found.

    Each level is added to one table by depth, so what is written grows with the nodes and not
    with nodes times depth; cycles end at nodes that have been seen.
    """
    spark, path = roots.sparkSession, new_path(roots.sparkSession, "bfs")
    front = roots.select("id").distinct().withColumn("depth", F.lit(0))
    schema, depth = front.schema, 0
    while True:
        front.write.mode("append").parquet(f"{path}/level={depth}")
        front = spark.read.schema(schema).parquet(f"{path}/level={depth}")
        if front.isEmpty():
            return spark.read.schema(schema).parquet(path).select("id", "depth")
        seen = spark.read.schema(schema).parquet(path).select("id")
        depth += 1
        found = front.select(c("id").alias("parent")).join(links, "parent").select(c("child").alias("id")).distinct()
        front = found.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"))


def refreshed(found: DataFrame, stored: DataFrame, remote: DataFrame) -> DataFrame:
    """``found`` with ``refreshed``: not where the store has the remote version or a later one."""
    own, there = stored.select("id", c("version").alias("__own")), remote.select("id", c("version").alias("__there"))
    met = found.join(own, "id", "left").join(there, "id", "left")
    return met.withColumn("refreshed", ~F.coalesce(c("__own") >= c("__there"), F.lit(False))).drop("__own", "__there")
