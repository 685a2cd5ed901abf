"""Goldens traced by hand, and the registry held against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.functions import finance as N
from lodestone.functions import logs as L
from lodestone.functions import markup
from lodestone.functions import text as X
from lodestone.operators import index as I
from lodestone.operators import keywords as K
from lodestone.operators import store as S
from lodestone import registry

DATA = Path("/root/testdata/sf0.001")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("trade-1234-20260321", ["trade-1234-20260321", "trade", "1234", "20260321", "trade", "1234", "20260321"]),
        ("123.45", ["123.45", "123", "45"]),
        ("XMLParser", ["xml", "parser"]),
        ("TradeProcessor and the", ["trade", "processor"]),
        ("", []),
        ("é12 x99y", ["x99y", "12"]),
    ],
)
def test_words(spark, text, words):
    assert one(spark, X.words(F.col("t")), t=text) == words


def test_words_of_null(spark):
    assert spark.createDataFrame([(None,)], "t string").select(X.words(F.col("t")).alias("x")).first().x == []


def test_gram_slots(spark):
    assert one(spark, X.gram_slot_index(F.col("t")), t="fx-2024-00789") == 3
    assert one(spark, X.gram_slot_query(F.col("t")), t="fx-2024-00789") == 1


@pytest.mark.parametrize(("word", "mult"), [("sixsix", 1.0), ("sevense", 1.1), ("eighteig", 1.2)])
def test_length_multiplier(spark, word, mult):
    assert one(spark, X.length_multiplier(F.col("t")), t=word) == pytest.approx(mult)


def test_idf(spark):
    assert one(spark, I.idf(F.lit(10), F.lit(3))) == pytest.approx(1.145132258848456)


def test_fold(spark):
    hits = spark.createDataFrame([("f", 1, "t1", "W", "A"), ("f", 2, "t2", "W", "B"), ("f", 3, "t3", "W", "B"), ("f", 4, "t4", "W", "B"), ("f", 5, "t5", "W", "B"), ("f", 6, "t6", "E", "C")], "file string, line_no int, time string, level string, class_name string")
    got = [r.event for r in L.folded(hits, ["file"], "line_no").orderBy("run").collect()]
    assert got == ["t1 [W][A]", "t2 [W][B] (x4 times)", "t6 [E][C]"]


def lines(spark, *texts):
    return spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(texts)], "file string, line_no long, line string")


def test_time_window(spark):
    rows = lines(spark, "at start", "2026-04-11 10:00:00.000 INFO [m] a.B - x", "  at more", "2026-13-40 10:00:00.000 INFO [m] a.B - x", "2026-04-12 23:30:00.000 WARN [m] a.B - x")
    assert [r.line_no for r in L.in_time(rows, "9:30", "10:30").orderBy("line_no").collect()] == [2, 3, 4]
    assert L.in_time(rows, "23:00", "01:00").count() == 0
    with pytest.raises(ValueError):
        L.hhmm("25:00")


def test_tail_before_include(spark):
    rows = lines(spark, "x", "y", "z")
    assert L.including(L.tail(rows, 2), "x").count() == 0


def test_privacy(spark):
    parts = L.line_parts(F.lit("2026-04-11 10:00:00.123 warn  [main] com.app.Order - secret"))
    assert set(parts) == {"time", "level", "class_name"}
    got = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert (got.time, got.level, got.class_name) == ("2026-04-11T10:00:00Z", "WARN", "Order")


@pytest.mark.parametrize(("n", "q", "kind", "algo", "route"), [(2500.0, 10, "LIMIT", "", "SMART_ORDER_ROUTER"), (600000.0, 2000, "LIMIT", "", "DARK_POOL"), (300000.0, 6000, "LIMIT", "", "ALGO_ENGINE:VWAP"), (0.0, 100, "MARKET", "", "DMA"), (1.0, 1, "LIMIT", "TWAP", "ALGO_ENGINE:TWAP")])
def test_route(spark, n, q, kind, algo, route):
    assert one(spark, N.route(F.col("n"), F.col("q"), F.col("k"), F.col("a")), n=n, q=q, k=kind, a=algo) == route


def priced(spark, spot, call):
    rows = spark.createDataFrame([(spot, 180.0, 0.05, 0.25, call)], "s double, k double, r double, sigma double, is_call boolean")
    return N.option_price(rows).first().price


def test_put_call_parity(spark):
    assert priced(spark, 175.0, True) - priced(spark, 175.0, False) == pytest.approx(175 - 180 * math.exp(-0.05), abs=1e-5)
    assert priced(spark, 0.0, True) is None


def test_yield_prices_the_bond(spark):
    y = one(spark, N.yield_to_maturity(F.lit(95.0), F.lit(100.0), F.lit(4.0), F.lit(10)))
    assert sum(4 / (1 + y) ** t for t in range(1, 11)) + 100 / (1 + y) ** 10 == pytest.approx(95)


def test_settlement(spark):
    rows = spark.createDataFrame([("US0378331005", 100.0), ("BAD", 100.0), ("US0378331005", 500000.0), (None, 1.0)], "isin string, amount double")
    s = N.settlement_state(F.col("isin"), F.col("amount"))
    assert [(r.status, r.reason) for r in rows.select(s["status"].alias("status"), s["reason"].alias("reason")).collect()] == [("SETTLED", None), ("FAILED", "Invalid ISIN"), ("FAILED", "Insufficient funds"), ("FAILED", "Invalid ISIN")]


def test_markup():
    assert markup.markdown_of("<h2>A &amp; b</h2><p>x <b>y</b></p><ul><li>z</li></ul><script>no</script>") == "## A & b\n\nx **y**\n\n- z"
    assert markup.balanced_json('see {"a": {"b": "}"}} end') == '{"a": {"b": "}"}}'
    assert markup.balanced_json("none") is None and markup.balanced_json(None) is None


def test_store(spark):
    old = spark.createDataFrame([("1", 1), ("2", 2)], "id string, version int")
    new = spark.createDataFrame([("2", 3), ("3", 1)], "id string, version int")
    assert sorted(map(tuple, S.upsert(old, new).collect())) == [("1", 1), ("2", 3), ("3", 1)]
    assert sorted(r.id for r in S.stale(old, new).collect()) == ["2", "3"]
    assert {r.id: r.state for r in S.put(old, new).collect()} == {"2": "accepted", "3": "missing"}


def test_reached(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "parent string, child string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert sorted(map(tuple, S.reached(roots, tree).collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_sources(spark, tmp_path):
    from lodestone.sources import files

    (tmp_path / "s" / "7").mkdir(parents=True)
    (tmp_path / "s" / "7" / "metadata.json").write_text('{"id": "7", "title": "new"}')
    (tmp_path / "s" / "7.json").write_text('{"id": "7", "title": "old"}')
    (tmp_path / "s" / "8.json").write_text("{broken")
    (tmp_path / "s" / "7" / "content.md").write_text("body\nof two lines")
    (tmp_path / "s" / "app-20260411141244484.log").write_text("one\ntwo\n")
    path = str(tmp_path / "s")
    assert [(r.id, r.title) for r in files.read_metadata(spark, path).collect()] == [("7", "new")]
    assert [tuple(r) for r in files.read_bodies(spark, path).collect()] == [("7", "body\nof two lines")]
    assert [tuple(r) for r in files.read_logs(spark, path).collect()] == [("app-20260411141244484.log", 1, "one"), ("app-20260411141244484.log", 2, "two")]


    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "b.md").write_text(" second \n")
    (tmp_path / "p" / "a.md").write_text("first")
    assert files.prompt_text(spark, str(tmp_path / "p"), 100) == "first\n\nsecond"
    (tmp_path / "logs.csv").write_text("environment|type|tags|base_url|summary\nprod|logtail|oms,fx|https://l|all\n")
    assert [tuple(r) for r in files.read_log_catalogue(spark, str(tmp_path / "logs.csv")).collect()] == [("prod", "logtail", ["oms", "fx"], "https://l", "all")]


# ---- keywords and synonyms
@pytest.mark.parametrize(
    ("line", "parts"),
    [
        ("2026-04-11 14:13:17 warn [main] com.app.Order", ("2026-04-11T14:13:17Z", "WARN", "Order")),
        ("2026-04-11 14:13:17.645 ERROR [a b] Svc$1 - x", ("2026-04-11T14:13:17Z", "ERROR", "Svc$1")),
        ("2026-13-40 14:13:17.645 ERROR [a] Svc - x", (None, None, None)),
        ("  at com.app.Order", (None, None, None)),
    ],
)
def test_entries(spark, line, parts):
    got = spark.createDataFrame([(line,)], "line string").select(*[x.alias(n) for n, x in L.line_parts(F.col("line")).items()]).first()
    assert tuple(got) == parts


@pytest.mark.parametrize(("text", "pattern"), [("US-0033", r"[A-Za-z]{2}-\d{4}"), ("aB1", r"[A-Za-z][A-Za-z]\d"), ("a..b", r"[A-Za-z]\.{2}[A-Za-z]")])
def test_structural_pattern(spark, text, pattern):
    assert one(spark, X.structural_pattern(F.col("t")), t=text) == pattern


@pytest.mark.parametrize(("synonym", "slot"), [(r"[A-Z]-\d+", 2), (r"[A-Za-z]{2}-\d{4}-\d", 3), ("123.456788", 1), ("fx-2024-00789", 3), ("risk manager", 2)])
def test_synonym_slot(spark, synonym, slot):
    assert one(spark, X.gram_slot_synonym(F.col("t")), t=synonym) == slot


@pytest.mark.parametrize(
    ("keyword", "synonyms"),
    [
        ("123.4567", ["123", "123.5", "123.46", "123.457", r"\d{3}\.\d{4}"]),
        ("TradeFlow", ["trade-flow"]),
        ("trade_flow", [r"[A-Za-z]{5}_[A-Za-z]{4}", "trade-flow"]),
        ("01/02/2024", [r"\d{2}/\d{2}/\d{4}", "01-02-2024"]),
    ],
)
def test_pattern_synonyms(spark, keyword, synonyms):
    got = one(spark, X.pattern_synonyms(F.col("t")), t=keyword)
    names = {n.lower(): p for n, p in X.PATTERNS}
    assert [s for s in got if s not in names] == synonyms
    import re

    assert [s for s in got if s in names] == [n for n, p in names.items() if re.search(p, keyword, re.I)]


@pytest.mark.parametrize(
    ("word", "suffix", "forms"),
    [("trade", "ing", ["tradeing", "trading"]), ("try", "ing", ["trying"]), ("trade", "ed", ["tradeed", "traded"]), ("happy", "ness", ["happyness", "happiness"]), ("class", "s", []), ("link", "age", ["linkage"]), ("trade", "age", []), ("act", "ion", ["action"]), ("use", "able", ["useable"]), ("value", "able", ["valueable", "valuable"]), ("supply", "tion", ["supplition"])],
)
def test_lengthened(spark, word, suffix, forms):
    assert one(spark, K.lengthened(F.col("t"), suffix), t=word) == forms


@pytest.mark.parametrize(
    ("word", "suffix", "forms"),
    [("trading", "ing", ["trad", "trade"]), ("sing", "ing", []), ("happily", "ly", ["happi", "happy"]), ("happiness", "ness", ["happi", "happy"]), ("traded", "ed", ["trad"]), ("valuable", "able", ["valu", "value"]), ("condition", "tion", ["condi", "condy"]), ("traders", "s", ["trader"])],
)
def test_shortened(spark, word, suffix, forms):
    assert one(spark, K.shortened(F.col("t"), suffix), t=word) == forms


def test_positions_of_keywords(spark):
    rows = spark.createDataFrame([("d", ["fx", "FX ", "fx", "trade"])], "doc_id string, k array<string>")
    got = {(r.gram, r.token): r.positions for r in K.categorised(rows, "title", F.col("k")).collect()}
    assert got == {(1, "fx"): [0.0, 0.25, 0.5], (1, "trade"): [0.75]}
    odd = spark.createDataFrame([("d", ["the", "x", "a b c d e", "v1.2-3", "ok"]), ("n", None)], "doc_id string, k array<string>")
    assert {(r.doc_id, r.gram, r.token): r.positions for r in K.categorised(odd, "kg", F.col("k")).collect()} == {("d", 4, "a b c d e"): [0.4], ("d", 3, "v1.2-3"): [0.6], ("d", 1, "ok"): [0.8]}


def test_clean_keywords(spark):
    assert one(spark, K.cleaned(K.given(F.col("t"))), t="Beta, alpha;beta|x\n ALPHA , gamma") == ["Beta", "alpha", "gamma"]
    assert one(spark, K.cleaned(K.given(F.col("t")), 1), t="b1,a1") == ["b1"] and one(spark, K.cleaned(K.given(F.col("t"))), t="") == []


def test_flattened_order(spark):
    rows = spark.createDataFrame([("d", "semantic", 1, "zeta", [0.0]), ("d", "title", 2, "b c", [0.1]), ("d", "title", 1, "mid", [0.5]), ("d", "title", 1, "2024", [0.9]), ("d", "semantic", 1, "mid", [0.0])], "doc_id string, category string, gram int, token string, positions array<double>")
    assert K.flattened(rows).first().keywords == ["2024", "mid", "b c", "zeta"]


def test_keyword_build(spark):
    docs = spark.createDataFrame([(7, "Trade Flow", "Traders trade. Fast", "# Risk Manager\n\nUse **Order Book** and `submitOrder`.\n\n```\nFX-2024 call\n```\n", 'graph TD\n A["Risk Desk"]', ["kept one"])], "doc_id long, title string, summary string, content string, graph string, semantic array<string>")
    dictionary = spark.createDataFrame([("trader",), ("trading",), ("trade",)], "w string")
    got = {(r.category, r.token): (r.gram, r.positions) for r in K.build(docs, 1, spark.createDataFrame([(7, ["alpha", "Alpha", "beta"])], "doc_id long, keywords array<string>"), dictionary).collect()}
    assert got["title", "trade flow"] == (2, [0.6667]) and got["title", "trade"] == (1, [0.0])
    assert got["structural", "risk manager"][0] == 2 and ("structural", "order book") in got and ("structural", "submitorder") in got and got["structural", "fx-2024"][0] == 2
    assert got["semantic", "kept one"] == (2, [0.0]) and ("semantic", "traders trade") in got
    assert got["bm25", "alpha"] == (1, [0.0]) and got["bm25", "beta"] == (1, [0.5])
    assert ("kg", "risk desk") in got
    # A synonym has the places of the words that it comes from.
    assert got["synonyms", "trading"] == (1, sorted({*got["title", "trade"][1], *got["semantic", "trade"][1]}))
    assert K.build(docs.limit(0), 0).count() == 0


def test_synonyms_within_the_row_are_those_of_columns(spark):
    odd = ["555-123.4567", "01/02/2024", "2024-01-02", "TradeFlow", "trade_flow", "9.995", "0.0050", "12345678901234567890123.25", "US1234567890", "a@b.co", "123K", "https://a.bc/x", "[a-z]{3}-x", "\u0663\u0663\u0663", "\u00e9555-123-4567", "a  b", " ", "\u017fix"]
    got = spark.createDataFrame([(t,) for t in odd], "t string").select("t", X.pattern_synonyms(F.col("t")), X.gram_slot_synonym(F.col("t")), X.structural_pattern(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(t, list(markup.pattern_forms(t)), markup.synonym_slot(t), markup.structure_of(t)) for t in odd]

    docs = spark.createDataFrame([(i, f"Trade Flow {i}", "Traders of 2024-01-02", f"# Risk\n\n**Order Book** `submitOrder` trading FX-{i}", None, ["Kept one", "kept_one"]) for i in range(20)] + [(99, None, None, None, None, None)], "doc_id long, title string, summary string, content string, graph string, semantic array<string>")
    dictionary = spark.createDataFrame([("trader",), ("trading",), ("trade",)], "w string")
    stored = K.base_categories(docs, 21)
    base = stored.select("doc_id", F.inline("stored"))
    made = K.synonym_positions(K.synonyms(K.flattened(base), dictionary), base)
    row = lambda df: sorted((r.doc_id, r.category, r.gram, r.token, tuple(r.positions)) for r in df.collect())
    assert row(K.build(docs, 21, None, dictionary)) == row(base.unionByName(made))
    # Nothing is sent to be put together.
    assert "Exchange" not in K.build(docs, 21)._jdf.queryExecution().executedPlan().toString()


def test_words_of_markup_are_words(spark):
    texts = ["trade-1234-20260321 XMLParser a_b 12 x99y é12 don't 3.14", "The QUICK brownFox v1.2.3-beta http://x/y", ""]
    for t in texts:
        assert markup.words_of(t) == one(spark, X.words(F.col("t")), t=t)


def test_postings_read_by_token(spark, tmp_path):
    posts = spark.createDataFrame([(i, "bm25", 1, f"t{i % 50}", 1) for i in range(500)], "doc_id long, category string, gram int, token string, tf long")
    I.store_postings(posts, str(tmp_path / "p"))
    found = I.stored_postings(spark, str(tmp_path / "p"), ["t7"])
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1][:60] and "PushedFilters: [In(token" in plan or "EqualTo(token" in plan


def test_corpus_counts(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, None), (3, "beta")], "doc_id long, text string")
    tf = {(r.doc_id, r.gram): (r.n, r.tf, r.dl) for r in I.frequencies(docs, "doc_id", "text").collect()}
    assert tf == {(1, "alpha"): (1, 2, 6), (1, "beta"): (1, 1, 6), (1, "alpha beta"): (2, 1, 6), (1, "beta alpha"): (2, 1, 6), (1, "alpha beta alpha"): (3, 1, 6), (3, "beta"): (1, 1, 1)}
    assert tuple(I.corpus(docs).first()) == (3, pytest.approx(7 / 3)) and tuple(I.corpus(docs.limit(0)).first()) == (0, 1.0)


def test_deep_hierarchy(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "parent long, child long")
    assert S.reached(spark.range(1).select("id"), chain).count() == 61


def rows_of(frame_rows, columns):
    def plain(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, (int, float)):
            return round(float(v), 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return str(v)

    return sorted((tuple(plain(x) for x in r) for r in frame_rows), key=repr)


@pytest.fixture(scope="session")
def tables():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    assert len({x.lower() for x in columns}) == len(columns)
    got = rows_of(df.select(*[f"`{c}`" for c in columns]).collect(), columns)
    found = tables.execute(registry.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == rows_of([[r[i] for i in at] for r in found.fetchall()], columns)


@pytest.mark.skipif(not DATA.exists(), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_is_written(spark, tmp_path, name):
    df = registry.QUERIES[name](spark, str(DATA))
    assert len({x.lower() for x in df.columns}) == len(df.columns)
    df.write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.ORACLE) <= set(entry.oracle_sql())
    if DATA.exists():
        assert entry.entry(spark).columns


def test_entry_without_the_training_data_package(tmp_path):
    """A copy without the subpackage and its tests imports and lists all other queries."""
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE))]


def test_first_letter_in_upper_case(spark):
    # Letters whose upper case is spelled with several: the single capital, or the letter itself.
    given = ["ßen on", "ŉ a", "ᾀb", "ᾈb", "ﬁn", "épée", "1a", "", "x"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, text string")
    got = [r.x for r in rows.orderBy("i").select(X.capitalised(F.col("text")).alias("x")).collect()]
    assert got == ["ẞen on", "ŉ a", "ᾈb", "ᾈb", "ﬁn", "Épée", "1a", "", "X"]


def test_keywords_within_the_row(spark):
    docs = spark.createDataFrame([(1, "Order Flow", "order flow 12 7 12 a-b_c and 4294967296"), (2, None, ""), (3, "x", "Trade trade")], "doc_id long, title string, text string")
    parts = [K.categorised(docs, k, K.tokens(F.col(x))) for k, x in (("title", "title"), ("semantic", "text"))]
    stored, rows = parts[0].unionByName(parts[1]), K.of_texts(docs, {"title": "title", "semantic": "text"}).where(F.size("keywords") > 0)
    every = lambda df: sorted(map(tuple, df.select("doc_id", "category", "gram", "token", "positions").collect()))
    assert every(rows.select("doc_id", F.inline("stored"))) == every(stored) != []
    assert sorted(map(tuple, rows.select("doc_id", "keywords").collect())) == sorted(map(tuple, K.flattened(stored).collect()))
    assert all("Exchange" not in x._jdf.queryExecution().executedPlan().toString() for x in (stored, rows))


def test_layers_of_one_kind_count_their_own_tokens_only(spark, monkeypatch):
    from lodestone import registry
    from lodestone.operators import index as I

    asked, real = [], I.best_among
    monkeypatch.setattr(I, "best_among", lambda docs, tokens, *rest: asked.append(tokens) or real(docs, tokens, *rest))
    assert registry.QUERIES["rnk_whole_query"](spark, "/root/testdata/sf0.001").count() == 200
    registry.QUERIES["rnk_term"](spark, "/root/testdata/sf0.001")
    assert asked == [["src7"], "ci der die und les src7".split()]


def test_marks_grow_with_the_wanted_grams(spark, monkeypatch):
    """With a bitmap that is full, every gram of every text would be sent to the join; counts are right with any."""
    from lodestone.operators import index as I

    docs = spark.createDataFrame([(i, f"alpha beta word{'abcdefghij'[i]}") for i in range(10)], "doc_id long, text string")
    wanted = spark.createDataFrame([("alpha beta",), ("beta",), ("worda",), ("none",)], "gram string")
    sent, real = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(len(x)) or real(self, x))
    counted = {r.gram: r.df for r in I.frequencies_of(docs, wanted).collect()}
    assert counted == {"alpha beta": 10, "beta": 10, "worda": 1}
    assert sent == [(1 << 20) // 8]


def test_long_texts_leave_the_workers_in_small_batches(spark):
    """A batch has 10,000 rows; what is made of them all at once would fill a worker."""
    import pyarrow as pa

    from lodestone.functions import markup
    from lodestone.operators import index as I

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["ab", None, "abcdef", "a" * 50, "", "abc", "b"])], names=["i", "t"])
    assert [p.column(0).to_pylist() for p in markup.slices(batch, 1, 8)] == [[0, 1, 2], [3], [4, 5, 6]]
    assert [p.num_rows for p in markup.slices(batch.slice(0, 0), 1)] == []
    docs = spark.createDataFrame([(1, "red blue red blue red"), (2, None), (3, "blue red x"), (4, "blue red")], "doc_id long, text string")
    rows = {tuple(r) for r in I.frequencies(docs, "doc_id", "text").where("doc_id = 1").collect()}
    assert (1, "red", 1, 3, 14) in rows and (1, "red blue", 2, 2, 14) in rows and (1, "red blue red blue", 4, 1, 14) in rows and len(rows) == 8
    assert I.grams(docs, "doc_id", "text").where("doc_id = 3").orderBy("n", "pos").select("n", "pos", "gram").collect()[:2] == [(1, 0, "blue"), (1, 1, "red")]


def test_customers_are_dealt_over_the_cores(spark, tmp_path):
    from lodestone.plans.base import Tables

    spark.range(8).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert Tables(spark, str(tmp_path)).customer.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_grams_of_lists_are_counted_in_pieces(spark, monkeypatch):
    """Grams are counted as numbers, and only the columns asked for leave the workers."""
    monkeypatch.setattr(I, "PIECE", 3)
    lists = [["a", "b", "a", "b", "a"], [], ["é", "a"], ["b"], ["x", "x", "x", "x", "x"]]
    pieces = list(I.counted_grams(lists))
    want = Counter((i, n, " ".join(w[j : j + n])) for i, w in enumerate(lists) for n in range(1, 5) for j in range(len(w) - n + 1))
    found = [((i, n, g), k) for n, rows, tfs, grams in pieces for i, k, g in zip(rows.tolist(), tfs.tolist(), grams.to_pylist())]
    assert len(found) == len(want) and dict(found) == want and max(len(g) for *_, g in pieces) == 3
    assert list(I.counted_grams([[], []])) == [] == list(I.counted_grams([]))
    docs = spark.createDataFrame([("p", "red blue red blue"), ("q", None), ("q", "red")], "doc_id string, text string")
    assert I.frequencies(docs, "doc_id", "text", columns=[]).columns == ["doc_id", "gram"]
    rows = I.frequencies(docs, "doc_id", "text", columns=["tf", "n"]).collect()
    assert sorted(map(tuple, rows)) == sorted([("p", "red", 2, 1), ("p", "blue", 2, 1), ("p", "red blue", 2, 2), ("p", "blue red", 1, 2), ("p", "red blue red", 1, 3), ("p", "blue red blue", 1, 3), ("p", "red blue red blue", 1, 4), ("q", "red", 1, 1)])


def test_long_runs_of_letters_are_gone_through_once():
    """A run without a separator was tried from each of its places, in time as its square; words without humps don't fill the cache."""
    began = time.process_time()
    assert markup.words_of(f"{'ab' * 60_000} {'a' * 60_000}-b cd") == [f"{'a' * 60_000}-b", "cd"]
    assert time.process_time() - began < 5
    markup._parts.cache_clear()
    assert markup.words_of("The Quick brown oneTwo a_bc USA x1 And " + "x" * 65) == ["a_bc", "bc", "quick", "brown", "one", "two", "bc", "usa", "x1"]
    assert markup._parts.cache_info().currsize <= 6


def test_bases_undo_lengthened(spark):
    """A word of the dictionary is cut to what it may come from: few candidates, where each word was lengthened in forty ways or so."""
    stems = "trade happy try act link class value supply use logic cat sees ail".split()
    made = spark.createDataFrame([(w,) for w in stems], "w string")
    forms = made.select("w", F.explode(F.flatten(F.array(*[F.transform(K.lengthened(F.col("w"), s), lambda x: F.struct(F.lit(s).alias("suffix"), x.alias("synonym"))) for s in K.SUFFIXES]))).alias("f")).select("w", "f.*")
    want = {(r.w, r.suffix, r.synonym) for r in forms.collect()}
    back = forms.select("synonym").distinct().select("synonym", F.explode(K.bases(F.col("synonym"))).alias("f")).select("f.w", "f.suffix", "synonym").collect()
    assert len(back) == len(set(back)) and {tuple(r) for r in back if r.w in stems} == want
    known = spark.createDataFrame([(w,) for w in ["trade", "trading", "trades", "traded", "try", "at", "ats", "Xs", "happiness", "happy", "happy"]], "w string")
    found = K.related_words(known.distinct(), known, K.lengthened)
    assert sorted(map(tuple, found.collect())) == [("happy", "ness", "happiness"), ("trade", "ed", "traded"), ("trade", "ing", "trading"), ("trade", "s", "trades")]
    generated = known.select(F.explode(K.bases(F.col("w")))).count()
    assert generated <= 2 * known.count()


def test_base_words_are_found_before_they_are_sent(spark, monkeypatch):
    texts = ["The fooBar_baz fooBar_baz 12abc-qux qux 3.14 a_b", None, "", "qux QUUX x_yyy-zz12 été", "foo's http://x/yyy.html " + "w" * 65]
    want = {w for t in texts for w in markup.words_of(t or "") if w.isascii() and w.isalpha() and len(w) > 2}
    docs = spark.createDataFrame([(t,) for t in texts * 3], "text string").coalesce(1)
    assert sorted(r.w for r in markup.base_words(docs, "text").collect()) == sorted(want)
    sent = markup.base_words(docs, "text")._jdf.queryExecution().optimizedPlan()
    assert "Generate" not in sent.toString() and want >= {"foo", "baz", "qux", "quux", "yyy", "html"}
    monkeypatch.setattr(markup, "MOST_SEEN", 2)
    assert sorted(r.w for r in markup.base_words(docs, "text").collect()) == sorted(want)
