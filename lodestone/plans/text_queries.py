"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.markup import first_places, html_to_markdown, json_block, markdown_keywords, word_lists
from lodestone.operators import keywords as K
from lodestone.plans.base import DOC_META_SQL, query

_ISSUE = "[A-Za-z]{2,10}-[0-9]+"
_SKIP = ", ".join(f"'{w}'" for w in X.SKIP_WORDS)
_VALID = f"(len(p) BETWEEN 2 AND 64 AND regexp_matches(p, '[a-z]') AND p NOT IN ({_SKIP}))"
_CAMEL = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), ' +'), lambda x: x <> '')"

def words_sql(source: str = "documents", id_: str = "doc_id", text: str = "text", p: str = "") -> str:
    """Words of a text in the order of three passes, as rows (doc_id, pos, w) of ``words`` with prefix ``p``, in DuckDB."""
    found = lambda pattern: f"unnest(regexp_extract_all({text}, '{pattern}')) AS m, unnest(range(len(regexp_extract_all({text}, '{pattern}')))) AS i FROM {source}"
    return rf"""
{p}c0 AS (SELECT {id_} AS doc_id, {found(X.COMPOUND)}),
{p}c1 AS (SELECT doc_id, i, m, unnest(string_split_regex(m, '[-_.+/]')) AS q, unnest(range(len(string_split_regex(m, '[-_.+/]')))) AS j FROM {p}c0 WHERE NOT regexp_full_match(m, '[0-9]+\.[0-9]+')),
{p}c2 AS (SELECT doc_id, i, j, CASE WHEN regexp_full_match(q, '[0-9]+') THEN [q] WHEN regexp_matches(q, '[A-Z]') AND regexp_matches(q, '[a-z]') THEN {_CAMEL.format("q")} ELSE [lower(q)] END AS ps FROM {p}c1 WHERE q <> ''),
{p}c3 AS (SELECT doc_id, i, j, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM {p}c2),
{p}w0 AS (SELECT {id_} AS doc_id, {found(X.WORD)}),
{p}w1 AS (SELECT doc_id, i, CASE WHEN regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') THEN {_CAMEL.format("m")} ELSE string_split(lower(m), '_') END AS ps FROM {p}w0),
{p}w2 AS (SELECT doc_id, i, unnest(ps) AS p, unnest(range(len(ps))) AS k FROM {p}w1),
{p}d0 AS (SELECT {id_} AS doc_id, {found(r'\b[0-9]{2,20}\b')}),
{p}every_word AS (SELECT doc_id, 1 AS pass, i, -1 AS j, 0 AS k, lower(m) AS p FROM {p}c0
  UNION ALL SELECT doc_id, 1, i, j, k, p FROM {p}c3 WHERE (regexp_full_match(p, '[0-9]+') AND len(p) BETWEEN 2 AND 64) OR {_VALID}
  UNION ALL SELECT doc_id, 2, i, 0, k, p FROM {p}w2 WHERE {_VALID}
  UNION ALL SELECT doc_id, 3, i, 0, 0, m FROM {p}d0),
{p}words AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pass, i, j, k) - 1 AS pos, p AS w FROM {p}every_word)"""


WORDS_SQL = words_sql()


@query("tok_words", f"WITH {WORDS_SQL} SELECT doc_id, pos, w FROM words")
def _(t):
    return word_lists(t.documents, "doc_id", "text").select("doc_id", F.posexplode("words").alias("pos", "w"))


@query("tok_camel", f"SELECT p_partkey, {_CAMEL.format("replace(p_name, ' ', '')")} AS parts FROM part")
def _(t):
    return t.part.select("p_partkey", X.camel_parts(F.replace("p_name", F.lit(" "), F.lit(""))).alias("parts"))


@query("tok_valid", f"WITH s AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS p FROM documents) SELECT p AS token, coalesce({_VALID}, false) AS valid FROM s")
def _(t):
    return t.documents.select(F.explode(F.split(F.lower("text"), " ")).alias("token")).distinct().select("token", X.is_valid_token(F.col("token")).alias("valid"))


@query("tok_unique", f"WITH {WORDS_SQL} SELECT doc_id, w, min(pos) AS first_pos FROM words GROUP BY ALL")
def _(t):
    return first_places(t.documents, "doc_id", "text").select("doc_id", F.inline("words"))


@query("tok_skipwords", f"WITH s AS (SELECT unnest([{_SKIP}]) AS word), w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) SELECT word, count(doc_id) AS documents FROM s LEFT JOIN w USING (word) GROUP BY word")
def _(t):
    # The list, with the number of documents that hold each word.
    words = t.documents.select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word")).where(F.col("word").isin(X.SKIP_WORDS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    listed = t.spark.createDataFrame([(w,) for w in X.SKIP_WORDS], "word string").distinct()
    return listed.join(words, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("documents"))


_SLOTS = "WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-_. ][A-Za-z0-9]+){0,5}')) AS token FROM documents) "


def _tokens(t):
    found = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+(?:[-_. ][A-Za-z0-9]+){0,5}"), F.lit(0))
    return t.documents.select(F.explode(found).alias("token")).distinct()


@query("tok_gram_slot_query", _SLOTS + "SELECT token, least(len(string_split_regex(trim(token), ' +')), 4)::INT AS slot FROM s")
def _(t):
    return _tokens(t).select("token", X.gram_slot_query(F.col("token")).alias("slot"))


@query("tok_gram_slot_index", _SLOTS + "SELECT token, least(CASE WHEN len(string_split_regex(trim(token), ' +')) > 1 THEN len(string_split_regex(trim(token), ' +')) ELSE greatest(len(list_filter(string_split_regex(token, '[-_.+/]'), lambda x: x <> '')), 1) END, 4)::INT AS slot FROM s")
def _(t):
    return _tokens(t).select("token", X.gram_slot_index(F.col("token")).alias("slot"))


@query("tok_gram_slot_syn", _SLOTS + """SELECT token, least(CASE WHEN len(string_split_regex(trim(token), ' +')) > 1 THEN len(string_split_regex(trim(token), ' +')) WHEN regexp_full_match(token, '[0-9]+\\.[0-9]+') THEN 1 ELSE greatest(len(list_filter(string_split_regex(token, '[-_.+/]'), lambda x: x <> '')), 1) END, 4)::INT AS slot FROM s""")
def _(t):
    return _tokens(t).select("token", X.gram_slot_synonym(F.col("token")).alias("slot"))


@query("rnk_len_mult", _SLOTS + "SELECT token, CASE WHEN len(regexp_replace(token, '[ \\t\\n\\r\\f]+', '', 'g')) >= 7 THEN 1.0::DOUBLE + (len(regexp_replace(token, '[ \\t\\n\\r\\f]+', '', 'g')) - 6) * 0.1::DOUBLE ELSE 1.0::DOUBLE END AS mult FROM s".replace("\\\\", "\\"))
def _(t):
    return _tokens(t).select("token", X.length_multiplier(F.col("token")).alias("mult"))


_PAT = "[" + ", ".join(f"CASE WHEN regexp_matches(token, '(?i){p}') THEN '{n}' END" for n, p in X.PATTERNS) + "]"
#: Names of the patterns of ``token``, and the structure of a column, in DuckDB.
PATTERNS_SQL, SKIP_SQL = _PAT, _SKIP
STRUCTURE_SQL = r"array_to_string(list_transform(regexp_extract_all({0}, '[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z]') THEN '[A-Za-z]' WHEN regexp_matches(r, '^[0-9]') THEN '\d' ELSE regexp_replace(r[1], '([\\.^$|?*+()\[\]{{}}])', '\\\1') END || CASE WHEN len(r) > 1 THEN '{{' || len(r) || '}}' ELSE '' END), '')"
_MADE = """WITH s AS (SELECT DISTINCT unnest([c_name, c_mktsegment, c_custkey::VARCHAR, 'US' || printf('%010d', c_custkey), printf('%09d', c_custkey), printf('%d.%02d', c_custkey, c_custkey % 100),
 'https://example.com/a/' || c_custkey, 'user' || c_custkey || '@example.com', printf('2024-%02d-%02d', c_custkey % 12 + 1, c_custkey % 28 + 1), c_custkey || 'K', 'ABC' || c_custkey, printf('%d,%03d', c_custkey % 900 + 1, c_custkey % 1000)]) AS token FROM customer) """


def _made(t):
    k = F.col("c_custkey")
    forms = ["c_name", "c_mktsegment", k.cast("string"), F.format_string("US%010d", k), F.format_string("%09d", k), F.format_string("%d.%02d", k, k % 100), F.concat(F.lit("https://example.com/a/"), k), F.concat(F.lit("user"), k, F.lit("@example.com")), F.format_string("2024-%02d-%02d", k % 12 + 1, k % 28 + 1), F.concat(k, F.lit("K")), F.concat(F.lit("ABC"), k), F.format_string("%d,%03d", k % 900 + 1, k % 1000)]
    return t.customer.select(F.explode(F.array(*forms)).alias("token")).distinct()


@query("pat_classify", _MADE + f"SELECT token, list_filter({_PAT}, lambda x: x IS NOT NULL) AS names FROM s")
def _(t):
    return _made(t).select("token", X.pattern_names(F.col("token")).alias("names"))


@query("pat_tokens", "WITH s AS (SELECT 'p' || p_partkey AS id, unnest([p_name, p_brand, p_retailprice::DECIMAL(18, 2)::VARCHAR, printf('2024-%02d-11', p_partkey % 12 + 1), 'ABC', 'mail ' || p_partkey || '@example.com', 'see https://example.com/p/' || p_partkey || ' or 555-123-' || printf('%04d', p_partkey % 10000)]) AS text FROM part), "
    + "m AS (SELECT id, text, list_concat(list_concat([" + ", ".join(f"regexp_extract(text, '{p}')" for _, p in X.PATTERNS) + f"], regexp_extract_all(text, '{X.URL}')), regexp_extract_all(text, '{X.PHONE}')) AS found FROM s) SELECT id, text, list_filter(found, lambda x: x <> '') AS tokens FROM m")
def _(t):
    k = F.col("p_partkey")
    forms = ["p_name", "p_brand", F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.format_string("2024-%02d-11", k % 12 + 1), F.lit("ABC"), F.format_string("mail %d@example.com", k), F.format_string("see https://example.com/p/%d or 555-123-%04d", k, k % 10000)]
    texts = t.part.select(F.concat(F.lit("p"), k).alias("id"), F.explode(F.array(*forms)).alias("text"))
    return texts.select("id", "text", X.pattern_tokens(F.col("text")).alias("tokens"))


@query("pat_structural_regex", _MADE + f"SELECT token, {STRUCTURE_SQL.format('token')} AS pattern FROM s")
def _(t):
    return _made(t).select("token", X.structural_pattern(F.col("token")).alias("pattern"))


@query("md_capital_seq")
def _(t):
    return t.documents.select("doc_id", X.capital_sequences(F.col("text")).alias("sequences"))


_KINDS = {"compound": X.COMPOUND, "camel": X.CAMEL, "caps": X.CAPS, "snake": X.SNAKE}
# Documents have few identifiers of their own; each gets a line with some.
_WITH_NAMES = "text || chr(10) || 'getUser' || upper(lang[1]) || 'x fooBar BUY_LIMIT_' || doc_id % 7 || ' HTTP2 a_b' || doc_id % 5 || '_c v1.' || doc_id || '-beta XMLHttp ABCdef x_Y'"


@query("md_identifiers", f"WITH d AS (SELECT doc_id, {_WITH_NAMES} AS text FROM documents) SELECT doc_id, " + ", ".join(f"list_sort(list_distinct(regexp_extract_all(text, '{p}'))) AS {n}" for n, p in _KINDS.items()) + " FROM d")
def _(t):
    i = F.col("doc_id")
    said = F.concat("text", F.lit("\ngetUser"), F.upper(F.left("lang", F.lit(1))), F.lit("x fooBar BUY_LIMIT_"), i % 7, F.lit(" HTTP2 a_b"), i % 5, F.lit("_c v1."), i, F.lit("-beta XMLHttp ABCdef x_Y"))
    found = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all("said", F.lit(X.ascii_bounds(p)), F.lit(0))))
    return t.documents.select("doc_id", said.alias("said")).select("doc_id", *[found(p).alias(n) for n, p in _KINDS.items()])


@query("md_keywords")
def _(t):
    return markdown_keywords(html_to_markdown(t.pages, "page_id", "html"), "page_id", "markdown")


@query("html_to_md")
def _(t):
    return html_to_markdown(t.pages, "page_id", "html")


def _entities(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _tag(tag: str) -> str:
    inner = f"regexp_extract_all(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)"
    return f"list_transform({inner}, lambda x: trim({_entities("regexp_replace(x, '<[^>]*>', '', 'g')")}))"


@query("html_tags", f"WITH p AS (SELECT page_id, replace(html, '<title>', '<meta content=\"Alpha, beta;gamma\" name=\"Keywords\"><title>') AS html FROM pages) SELECT page_id, coalesce({_tag('title')}[1], {_tag('h1')}[1], '') AS title, list_concat(list_concat({_tag('h1')}, {_tag('h2')}), {_tag('h3')}) AS headings, CASE WHEN contains(html, 'name=\"Keywords\"') THEN ['Alpha', 'beta', 'gamma'] ELSE [] END AS keywords FROM p")
def _(t):
    tag = lambda n: X.tag_text(F.col("html"), n)
    first = lambda n: F.get(tag(n), F.lit(0))
    pages = t.pages.withColumn("html", F.replace("html", F.lit("<title>"), F.lit('<meta content="Alpha, beta;gamma" name="Keywords"><title>')))
    return pages.select("page_id", F.coalesce(first("title"), first("h1"), F.lit("")).alias("title"), F.concat(tag("h1"), tag("h2"), tag("h3")).alias("headings"), X.meta_keywords(F.col("html")).alias("keywords"))


@query("src_html_links", r"""SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS href FROM pages""")
def _(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))


@query("flt_is_html", "SELECT page_id, regexp_matches(trim(html), '(?is)<[a-z].*>') AS html_like, regexp_matches(trim(url), '(?is)<[a-z].*>') AS url_like FROM pages")
def _(t):
    like = lambda c: F.trim(c).rlike("(?is)<[a-z].*>")
    return t.pages.select("page_id", like("html").alias("html_like"), like("url").alias("url_like"))


@query("flt_not_found", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), '{p}')" for p in X.NOT_FOUND) + " AS not_found FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.lower("text").rlike("|".join(X.NOT_FOUND)).alias("not_found"))


_TRIM = r"regexp_replace({0}, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"


@query("txt_summary", rf"""
WITH RECURSIVE s AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: trim({_TRIM.format('x')})), lambda x: x <> '') AS ss FROM documents),
u AS (SELECT doc_id, unnest(ss) AS x, unnest(range(len(ss))) AS i FROM s),
r AS (SELECT doc_id, i, x, sum(len(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM u),
k AS (SELECT doc_id, string_agg(x || '.', ' ' ORDER BY i) AS out FROM r WHERE n <= 220 GROUP BY doc_id)
SELECT s.doc_id, coalesce(k.out, nullif(CASE WHEN len({_TRIM.format('text')}) > 220 THEN left({_TRIM.format('text')}, 220) || '...' ELSE {_TRIM.format('text')} END, ''), 'No summary available') AS summary FROM s LEFT JOIN k USING (doc_id)""")
def _(t):
    return t.documents.select("doc_id", X.summary(F.col("text")).alias("summary"))


_SQUEEZE = r"trim(regexp_replace(text, '[ \t\n\v\f\r]+', ' ', 'g'))"


@query("txt_truncate", "SELECT doc_id, CASE WHEN len(text) > 100 THEN left(text, 100) || '...' ELSE text END AS cut FROM documents")
def _(t):
    return t.documents.select("doc_id", X.truncated(F.col("text"), 100).alias("cut"))


@query("txt_preview", f"SELECT doc_id, CASE WHEN len({_SQUEEZE}) <= 180 THEN {_SQUEEZE} ELSE left({_SQUEEZE}, 177) || '...' END AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", X.preview(F.col("text")).alias("preview"))


@query("txt_sentence", f"SELECT doc_id, upper(left({_SQUEEZE}, 1)) || substr({_SQUEEZE}, 2) AS sentence FROM documents")
def _(t):
    return t.documents.select("doc_id", X.capitalised(X.squeezed(F.col("text"))).alias("sentence"))


SLUG_SQL = "coalesce(nullif(left(regexp_replace(trim(regexp_replace(lower(coalesce(nullif({0}, ''), 'item')), '[^a-z0-9-_ ]+', '', 'g')), ' +', '-', 'g'), 64), ''), 'item')"


@query("txt_slug", f"WITH {DOC_META_SQL} SELECT id, {SLUG_SQL.format('title')} AS slug FROM doc_meta")
def _(t):
    return t.doc_meta().select("id", X.slug(F.col("title")).alias("slug"))


@query("txt_escape_html", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents")
def _(t):
    return t.documents.select("doc_id", X.escaped_html(F.col("text")).alias("escaped"))


@query("txt_issue_keys", f"SELECT doc_id, k.keys FROM (SELECT doc_id, list_transform(regexp_extract_all('see proj-' || doc_id || ' and OPS-' || (doc_id % 7) || ' ' || text, '(?i){_ISSUE}'), lambda x: upper(x)) AS every FROM documents) s, LATERAL (SELECT list_filter(every, lambda x, i: list_position(every, x) = i) AS keys) k")
def _(t):
    text = F.concat(F.lit("see proj-"), "doc_id", F.lit(" and OPS-"), F.col("doc_id") % 7, F.lit(" "), "text")
    return t.documents.select("doc_id", X.issue_keys(text, [_ISSUE]).alias("keys"))


@query("txt_page_id", "SELECT page_id, nullif(regexp_extract(u, '(?i)(?:[?&]pageId=|/pages/|/viewpage/|\\.action/)([0-9]+)', 1), '') AS found, coalesce(nullif(regexp_extract(u, '(?i)[?&]pageId=([0-9]+)', 1), ''), regexp_extract(u, '(?i)/pages/([0-9]+)', 1)) AS linked FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '&pageId=' || page_id ELSE 'https://w.example.com/pages/' || page_id END AS u FROM pages)")
def _(t):
    url = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("&pageId="), "page_id")).otherwise(F.concat(F.lit("https://w.example.com/pages/"), "page_id"))
    return t.pages.select("page_id", X.page_id(url).alias("found"), X.link_page_id(url).alias("linked"))


_ARG = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://j.example.com/browse/PROJ-' || page_id WHEN 2 THEN (page_id + 10000000)::VARCHAR WHEN 3 THEN 'fix ab-' || page_id WHEN 4 THEN 'pageid=' || page_id ELSE 'nothing here' END"


@query("txt_refresh_arg", f"""WITH s AS (SELECT page_id, trim({_ARG}) AS raw FROM pages),
r AS (SELECT *, regexp_extract(raw, '(?i)https?://[^\\s)]+') AS url, regexp_extract(raw, '(?i)[A-Za-z]+-[0-9]+') AS key, coalesce(nullif(regexp_extract(raw, '(?i)pageid=([0-9]+)', 1), ''), regexp_extract(raw, '\\b([0-9]{{1,8}})\\b', 1)) AS num FROM s),
k AS (SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN url <> '' AND (regexp_matches(url, '(?i)/browse/[A-Za-z0-9\\-]+') OR regexp_matches(url, '(?i)[A-Za-z]+-[0-9]+')) THEN 'regex-jira' WHEN url <> '' THEN 'regex-url' WHEN regexp_matches(raw, '^[0-9]{{7,}}$') THEN 'regex-id' WHEN key <> '' THEN 'regex-jira' WHEN num <> '' THEN 'regex-id' ELSE 'none' END AS source FROM r)
SELECT page_id, source, CASE WHEN source IN ('empty', 'none') THEN '' WHEN url <> '' THEN url WHEN regexp_matches(raw, '^[0-9]{{7,}}$') THEN raw WHEN source = 'regex-jira' THEN key ELSE num END AS arg FROM k""")
def _(t):
    made = F.when(F.col("page_id") % 6 == 0, F.col("url")).when(F.col("page_id") % 6 == 1, F.concat(F.lit("https://j.example.com/browse/PROJ-"), "page_id")).when(F.col("page_id") % 6 == 2, (F.col("page_id") + 10000000).cast("string"))
    made = made.when(F.col("page_id") % 6 == 3, F.concat(F.lit("fix ab-"), "page_id")).when(F.col("page_id") % 6 == 4, F.concat(F.lit("pageid="), "page_id")).otherwise(F.lit("nothing here"))
    return t.pages.select("page_id", X.refresh_argument(made).alias("r")).select("page_id", "r.arg", "r.source")


@query("txt_resolve_url", "SELECT page_id, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u WHEN u LIKE '/confluence%' THEN 'https://wiki.example.com' || u WHEN u LIKE '/%' THEN 'https://wiki.example.com/confluence' || u ELSE 'https://wiki.example.com/confluence/' || u END AS resolved FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN '/confluence/pages/' || page_id WHEN 2 THEN '/pages/' || page_id ELSE 'pages/' || page_id END AS u FROM pages)")
def _(t):
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("/confluence/pages/"), "page_id")).when(k == 2, F.concat(F.lit("/pages/"), "page_id")).otherwise(F.concat(F.lit("pages/"), "page_id"))
    base = "https://wiki.example.com"
    found = F.when(u.rlike("(?i)^https?://"), u).when(u.startswith("/confluence"), F.concat(F.lit(base), u)).when(u.startswith("/"), F.concat(F.lit(base + "/confluence"), u)).otherwise(F.concat(F.lit(base + "/confluence/"), u))
    return t.pages.select("page_id", found.alias("resolved"))


@query("txt_is_issue_id", f"SELECT o_orderkey, regexp_full_match(CASE WHEN o_orderkey % 2 = 0 THEN 'OPS-' || o_orderkey ELSE o_orderpriority END, '(?i)(?:{_ISSUE})') AS is_issue FROM orders")
def _(t):
    made = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("OPS-"), "o_orderkey")).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", made.rlike(f"^(?i:{_ISSUE})$").alias("is_issue"))


@query("txt_feedback_target", f"WITH {DOC_META_SQL}, k AS (SELECT *, CASE WHEN type = 'src1' THEN 'https://j.example.com/browse/OPS-' || id ELSE url END AS u FROM doc_meta), f AS (SELECT *, upper(regexp_extract(u, '(?i){_ISSUE}')) AS key FROM k) SELECT id, CASE WHEN key = '' AND regexp_full_match(id, '[0-9]+') THEN id ELSE '' END AS page_id, key AS jira_id FROM f")
def _(t):
    url = F.when(F.col("type") == "src1", F.concat(F.lit("https://j.example.com/browse/OPS-"), "id")).otherwise(F.col("url"))
    key = F.upper(F.regexp_extract(url, f"(?i){_ISSUE}", 0))
    return t.doc_meta().select("id", F.when((key == "") & F.col("id").rlike("^[0-9]+$"), F.col("id")).otherwise("").alias("page_id"), key.alias("jira_id"))


@query("txt_top_doc", r"SELECT conv_id, turn, regexp_extract(m, '\[TOP_DOC_URL:\s*(.+?),\s*TOP_DOC_ID:\s*(.+?)\]', 1) AS url, regexp_extract(m, '\[TOP_DOC_URL:\s*(.+?),\s*TOP_DOC_ID:\s*(.+?)\]', 2) AS id FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN text || ' [TOP_DOC_URL: https://w.example.com/' || conv_id || ', TOP_DOC_ID: ' || conv_id || ']' ELSE text END AS m FROM conversations)")
def _(t):
    m = F.when(F.col("turn") % 2 == 1, F.concat("text", F.lit(" [TOP_DOC_URL: https://w.example.com/"), "conv_id", F.lit(", TOP_DOC_ID: "), "conv_id", F.lit("]"))).otherwise(F.col("text"))
    part = lambda n: F.regexp_extract(m, r"\[TOP_DOC_URL:\s*(.+?),\s*TOP_DOC_ID:\s*(.+?)\]", n)
    return t.conversations.select("conv_id", "turn", part(1).alias("url"), part(2).alias("id"))


@query("jira_md", r"SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim('h1. ' || lang || chr(13) || chr(10) || 'h3.  ' || source || chr(10) || 'body ' || doc_id), '(?m)^h1\.[ \t]+', '# ', 'g'), '(?m)^h2\.[ \t]+', '## ', 'g'), '(?m)^h3\.[ \t]+', '### ', 'g'), '(?m)^h4\.[ \t]+', '#### ', 'g'), chr(13) || chr(10), chr(10)) AS md FROM documents")
def _(t):
    return t.documents.select("doc_id", X.jira_markdown(F.concat(F.lit("h1. "), "lang", F.lit("\r\nh3.  "), "source", F.lit("\nbody "), "doc_id")).alias("md"))


_ISSUE_SQL = """i AS (SELECT o_orderkey, o_orderkey + 10000 AS id, CASE WHEN o_orderkey % 4 <> 0 THEN ' OPS-' || o_orderkey || ' ' END AS key, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN '  ' END AS summary,
 CASE WHEN o_orderkey % 5 <> 0 THEN 'h2. Status' || chr(13) || chr(10) || 'It is ' || o_orderstatus || '. ' END AS description, CASE WHEN o_orderkey % 6 <> 0 THEN 'OPS' END AS project, CASE WHEN o_orderkey % 7 = 0 THEN 'Bug' END AS type, o_orderstatus AS status, o_orderpriority AS priority,
 CASE WHEN o_orderkey % 2 = 0 THEN 'Clerk' || o_custkey END AS reporter, CASE WHEN o_orderkey % 11 = 0 THEN 'Titled' END AS html_title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS updated FROM orders),
 t AS (SELECT *, trim(coalesce(key, '')) AS k, trim(coalesce(summary, '')) AS s, coalesce(nullif(regexp_replace(trim(coalesce(description, '')), '(?m)^h2\\.[ \t]+', '## '), ''), 'No description provided.') AS d FROM i),
 u AS (SELECT *, coalesce(html_title, CASE WHEN k <> '' AND s <> '' THEN k || ': ' || s END, nullif(k, ''), nullif(s, ''), 'Issue ' || id) AS title FROM t)"""


def issues_of(t):
    """Orders as issues, with every field missing in some."""
    k = F.col("o_orderkey")
    some = lambda by, rest, value: F.when(k % by != rest, value)
    return t.orders.select(
        "o_orderkey", (k + 10000).alias("id"), some(4, 0, F.concat(F.lit(" OPS-"), k, F.lit(" "))).alias("key"), F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 3 == 1, "  ").alias("summary"),
        some(5, 0, F.concat(F.lit("h2. Status\r\nIt is "), "o_orderstatus", F.lit(". "))).alias("description"), some(6, 0, F.lit("OPS")).alias("project"), F.when(k % 7 == 0, "Bug").alias("type"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.when(k % 2 == 0, F.concat(F.lit("Clerk"), "o_custkey")).alias("reporter"), F.lit(None).cast("string").alias("assignee"), F.when(k % 11 == 0, "Titled").alias("html_title"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("updated"),
    )


@query("jira_render", f"WITH {_ISSUE_SQL} SELECT o_orderkey, title, concat_ws(chr(10), '# ' || title, '', 'Issue Key: ' || coalesce(nullif(k, ''), '-'), 'Issue ID: ' || id, 'Project: ' || coalesce(project, 'Jira'), 'Type: ' || coalesce(type, '-'), 'Status: ' || status, 'Priority: ' || priority, 'Reporter: ' || coalesce(reporter, 'Unknown'), 'Assignee: -', 'Updated: ' || updated, '', '## Description', replace(d, chr(13) || chr(10), chr(10))) AS markdown FROM u")
def _(t):
    issue = {n: F.col(n) for n in X.ISSUE_FIELDS}
    return issues_of(t).select("o_orderkey", X.issue_title(issue).alias("title"), X.issue_markdown(issue).alias("markdown"))


@query("json_first_object", "SELECT event_id, regexp_extract('noise ' || props || ' tail', '(?s)\\{.*\\}') AS found, (regexp_extract(props, '\"k\": *([0-9]+)', 1))::INT AS k FROM events")
def _(t):
    found = X.first_json_object(F.concat(F.lit("noise "), "props", F.lit(" tail")))
    return t.events.select("event_id", found.alias("found"), F.get_json_object(found, "$.k").cast("int").alias("k"))


@query("json_block", "SELECT event_id, props AS block FROM events")
def _(t):
    return json_block(t.events.select("event_id", F.concat(F.lit("text ```json\n"), "props", F.lit("\n``` end")).alias("text")), "event_id", "text")


@query("json_normalise_plan", "SELECT event_id, 'q' || event_id AS original_query, [event_type] AS proposed_keywords, CASE event_id % 3 WHEN 0 THEN '{\"app\":\"app\",\"oms\":\"oms\"}' WHEN 1 THEN '{\"app\":\"https://l/' || event_id || '\"}' END AS proposed_logs FROM events")
def _(t):
    # Logs are named in a list, in a map from name to place, or not at all; a list becomes a map of names to themselves.
    k = F.col("event_id") % 3
    logs = F.when(k == 0, F.lit('["app","oms"]')).when(k == 1, F.concat(F.lit('{"app":"https://l/'), "event_id", F.lit('"}')))
    said = F.to_json(F.struct(F.concat(F.lit("q"), "event_id").alias("query"), F.array("event_type").alias("keywords")))
    plan = F.when(logs.isNull(), said).otherwise(F.concat(F.regexp_replace(said, r"\}$", ""), F.lit(',"proposed_logs":'), logs, F.lit("}")))
    kw = F.from_json(F.coalesce(F.get_json_object(plan, "$.proposed_keywords"), F.get_json_object(plan, "$.keywords")), "array<string>")
    return t.events.select("event_id", F.coalesce(F.get_json_object(plan, "$.original_query"), F.get_json_object(plan, "$.query")).alias("original_query"), F.when(F.size(kw) > 0, kw).alias("proposed_keywords"), X.log_map(F.get_json_object(plan, "$.proposed_logs")).alias("proposed_logs"))


@query("json_parse_eval", "SELECT event_id, [event_id::VARCHAR] AS relevant_ids, []::VARCHAR[] AS irrelevant_ids, event_id % 2 = 0 AS satisfied, '' AS answer FROM events")
def _(t):
    said = F.concat(F.lit('{"relevantIds":["'), "event_id", F.lit('"],"satisfied":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}"))
    parsed = F.from_json(said, "relevantIds array<string>, irrelevantIds array<string>, satisfied boolean, answer string")
    none = F.array().cast("array<string>")
    return t.events.select("event_id", parsed.alias("p")).select("event_id", F.coalesce("p.relevantIds", none).alias("relevant_ids"), F.coalesce("p.irrelevantIds", none).alias("irrelevant_ids"), F.coalesce("p.satisfied", F.lit(False)).alias("satisfied"), F.coalesce("p.answer", F.lit("")).alias("answer"))


_GRAPH = 'graph TD\n A["{0}"] --> B[Order Flow]\n B --> Clearing'


@query("mm_entities")
def _(t):
    g = F.format_string(_GRAPH.replace("{0}", "%s"), F.col("title"))
    return t.doc_meta().select("id", K.entity_tokens(g).alias("tokens"))


_GRAPH_SQL = "('graph TD' || chr(10) || ' A[\"' || title || '\"] --> B[Order Flow]' || chr(10) || ' B --> Clearing')"


_CHART_SQL = "('graph TD' || chr(10) || ' A[\"' || title || '\"] --> B[Order Flow]' || chr(10) || ' B -->|sends it ' || type || '| ClearingHouse' || chr(10) || ' ClearingHouse -- \"by night\" --> RiskDesk2(Final x)' || chr(10) || 'end')"
_LONG = "list_filter({0}, lambda w: len(w) >= 2)"
_PHRASES = f"flatten(list_transform({_LONG.format('list_transform({0}, lambda x: trim(x))')}, lambda x: list_concat([lower(x)], list_transform({_LONG.format("string_split_regex(x, '[ ]+')")}, lambda w: lower(w)))))"


def _found(pattern: str) -> str:
    return f"regexp_extract_all(l, '{pattern}', 1)"


_OF_LINE = f"list_concat(list_concat({_PHRASES.format(_found(X.MERMAID_LABEL))}, flatten(list_transform({_found(X.MERMAID_NAME)}, lambda x: list_concat({_LONG.format("string_split(lower(regexp_replace(x, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), ' ')")}, [lower(x)])))), list_concat({_PHRASES.format(_found(X.MERMAID_EDGES[0]))}, {_PHRASES.format(_found(X.MERMAID_EDGES[1]))}))"


@query("mm_keywords", f"WITH {DOC_META_SQL}, g AS (SELECT id, unnest(string_split({_CHART_SQL}, chr(10))[2:]) AS l FROM doc_meta), k AS (SELECT id, unnest({_OF_LINE}) AS k FROM g) SELECT id, list_sort(list(DISTINCT k)) AS keywords FROM k WHERE k NOT IN ({', '.join(repr(x) for x in X.MERMAID_NOISE)}) GROUP BY id")
def _(t):
    chart = F.concat(F.lit('graph TD\n A["'), "title", F.lit('"] --> B[Order Flow]\n B -->|sends it '), "type", F.lit('| ClearingHouse\n ClearingHouse -- "by night" --> RiskDesk2(Final x)\nend'))
    return t.doc_meta().select("id", F.array_sort(X.mermaid_keywords(chart)).alias("keywords"))


@query("mm_clean", f"""WITH {DOC_META_SQL} SELECT id, trim(regexp_replace(regexp_extract(regexp_replace('```mermaid' || chr(10) || {_GRAPH_SQL} || chr(10) || '```', '```(?:mermaid)?', '', 'g'), '(?s)graph\\s+(?:TD|LR|BT|RL).*'), '\\["([^"]*)"\\]', '[\\1]', 'g')) AS graph FROM doc_meta""")
def _(t):
    fenced = F.concat(F.lit("```mermaid\n"), F.format_string(_GRAPH.replace("{0}", "%s"), F.col("title")), F.lit("\n```"))
    bare = F.regexp_replace(fenced, "```(?:mermaid)?", "")
    graph = F.regexp_extract(bare, r"(?s)graph\s+(?:TD|LR|BT|RL).*", 0)
    return t.doc_meta().select("id", F.trim(F.regexp_replace(graph, r'\["([^"]*)"\]', "[$1]")).alias("graph"))


def _escaped(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


_FAILED = "'Failed to connect to Confluence server: '"


@query("txt_error_map", f"""WITH e AS (SELECT event_id, event_id % 12 AS k, [400, 401, 402, 403, 404, 504, 500, 503, 302][event_id // 12 % 9 + 1] AS s FROM events)
SELECT event_id, CASE k WHEN 0 THEN {_FAILED} || 'no such space ' || event_id WHEN 1 THEN {_FAILED} || 'denied' WHEN 2 THEN {_FAILED} || 'late' WHEN 3 THEN 'Confluence base URL not configured. Please set the repoAsk.confluence.url setting.'
 WHEN 4 THEN {_FAILED} || 'Connection timed out. Please check your network connection and server URL.' WHEN 5 THEN {_FAILED} || 'Connection timed out. Please check your network connection and server URL.'
 WHEN 6 THEN {_FAILED} || 'Connection refused. Please check if the server is running and the URL is correct.' WHEN 7 THEN {_FAILED} || 'EPIPE. Please check your network connection and server URL.'
 WHEN 8 THEN {_FAILED} || CASE s WHEN 400 THEN 'Bad Request (400). Please check your request data.' WHEN 401 THEN 'Unauthorized (401). Please check your credentials.' WHEN 402 THEN 'Payment Required (402).' WHEN 403 THEN 'Forbidden (403). You do not have permission to perform this action.'
  WHEN 404 THEN 'Page not found (404). Please check the URL and ensure the server is running.' WHEN 504 THEN 'Gateway Timeout (504). The server took too long to respond.' WHEN 302 THEN 'HTTP Error 302.' ELSE 'Server error (' || s || '). Please check if the server is running and accessible.' END
 WHEN 9 THEN {_FAILED} || 'Host not found. Please check the server URL.' WHEN 10 THEN 'Failed to submit feedback: odd ' || event_id ELSE 'Failed to submit feedback. Please try again.' END AS message,
 CASE k WHEN 0 THEN 'no such space ' || event_id WHEN 1 THEN 'denied' WHEN 2 THEN 'late' WHEN 3 THEN 'wiki not configured' WHEN 4 THEN 'timeout of 5000ms' WHEN 5 THEN '' WHEN 6 THEN 'ECONNREFUSED' WHEN 7 THEN 'broken pipe' WHEN 8 THEN 'text ' || s WHEN 9 THEN 'getaddrinfo ENOTFOUND' WHEN 10 THEN 'odd ' || event_id ELSE '' END AS detail FROM e""")
def _(t):
    i = F.col("event_id")
    k = i % 12
    case = lambda **by: F.coalesce(*[F.when(k == int(n[1:]), v if not isinstance(v, str) else F.lit(v)) for n, v in by.items()])
    body = case(_0=F.format_string('{"message": " no such space %d ", "error": "x"}', i), _1='{"message": "", "error": "denied"}', _2="  late ", _3="{}", _4="", _8="{}")
    message = case(_2="timeout", _3="wiki not configured", _4="timeout of 5000ms", _7="broken pipe", _9="getaddrinfo ENOTFOUND", _10=F.concat(F.lit("odd "), i))
    code = case(_5="ECONNABORTED", _6="ECONNREFUSED", _7="EPIPE")
    status = F.when(k == 8, F.get(F.array(*map(F.lit, (400, 401, 402, 403, 404, 504, 500, 503, 302))), F.floor(i / 12).cast("int") % 9))
    return t.events.select("event_id", F.inline(F.array(X.feedback_error(body, message, code, status, F.concat(F.lit("text "), status.cast("string"))))).alias("message", "detail"))


@query("txt_feedback_row", f"WITH r AS (SELECT conv_id, turn, '<tr><td>' || {_escaped('role')} || '</td><td>' || {_escaped('text')} || '</td></tr>' AS row FROM conversations) SELECT conv_id, turn, row, '<table><tbody>' || row || '</tbody></table>' AS page FROM r")
def _(t):
    cells = [F.concat(F.lit("<td>"), X.escaped_html(F.col(c)), F.lit("</td>")) for c in ("role", "text")]
    row = F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    return t.conversations.select("conv_id", "turn", row.alias("row"), F.replace(F.lit("<table><tbody></tbody></table>"), F.lit("</tbody>"), F.concat(row, F.lit("</tbody>"))).alias("page"))
