"""Quality rules as a bitmask ledger, in DataFrame functions only.

``measure`` evaluates every rule once and stores for each document its measurements and one
bit for each rule that it fails. ``apply_policy`` decides by a versioned policy: a mask of
rules that reject on their own and a number of other failed rules that reject together; no
text is read again for another policy. ``ablations`` counts, by bitwise aggregation over the
ledger, what each rule rejects alone and what dropping it would bring back.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule names in the order of their bits. A rule's SQL text is valid in Spark and in DuckDB.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("no_sentence_end", "n_sentence_ends = 0"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]


@dataclass(frozen=True)
class Policy:
    """``hard``: rules that reject alone; ``soft``: rules of which ``most_soft`` failures are still kept."""

    version: str
    hard: int
    soft: int = 0
    most_soft: int = 0


POLICIES = {
    "v1": Policy("v1", BASE),
    "v2": Policy("v2", BASE | BIT["many_symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"]),
    "v3": Policy("v3", BASE, BIT["many_symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"] | BIT["no_sentence_end"], 1),
}
DEFAULT = "v2"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ledger: id, ``carry`` columns, measurements and ``failed_bits``.

    A null text counts as empty and has no words: it fails ``few_words``. One row is made for
    each row given, repeated rows and null ids included. Whole texts are measured; the work
    for a text of n words is a sort of its n windows. Columns of ``docs`` other than those
    named never clash with the measurements, since only the named ones are read.
    """
    carried = [F.col(c).alias(f"__carry_{i}") for i, c in enumerate(carry or [])]
    base = docs.select(F.col(id_col).alias("__id"), *carried, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    words = F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("__text", "\n"), lambda x: _has_word(x))
    split = base.select("*", words.alias("__words"), lines.alias("__lines"))
    n = F.size("__words")
    # Sorted (window, position): equal windows are neighbours.
    windows = F.when(
        n >= 3,
        F.array_sort(F.transform(F.slice("__words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.struct(F.concat_ws(" ", w, F.get("__words", i + 1), F.get("__words", i + 2)).alias("w"), i.alias("p")))),
    ).otherwise(F.array().cast("array<struct<w:string,p:int>>"))
    sorted_ = split.select("*", windows.alias("__windows"))
    twice = F.filter("__windows", lambda x, i: (x["w"] == F.get("__windows", i - 1)["w"]) | (x["w"] == F.get("__windows", i + 1)["w"]))
    starts = sorted_.select("*", F.array_sort(F.transform(twice, lambda x: x["p"])).alias("__starts"))
    # Words covered by windows of three that start at the given places.
    covered = F.aggregate(
        "__starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )
    length = lambda c: F.length(c).cast("long")
    measured = starts.select(
        "__id",
        *[f"__carry_{i}" for i in range(len(carried))],
        F.size("__words").cast("long").alias("n_words"),
        length(_without(F.col("__text"), SPACE)).alias("word_chars"),
        (length("__text") - length(_without(F.col("__text"), SYMBOLS))).alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        (length("__text") - length(_without(F.col("__text"), ".!?"))).alias("n_sentence_ends"),
    )
    bits = None
    for name, rule in RULES:
        bit = F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    ledger = measured.withColumn("failed_bits", bits)
    return ledger.withColumnsRenamed({"__id": id_col} | {f"__carry_{i}": c for i, c in enumerate(carry or [])})


def _has_word(line: Column) -> Column:
    return F.translate(line, SPACE, "") != ""


def apply_policy(ledger: DataFrame, policy: Policy = POLICIES[DEFAULT]) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under the policy."""
    bits = F.col("failed_bits")
    soft = F.bit_count(bits.bitwiseAND(F.lit(policy.soft).cast("long")))
    return ledger.withColumns({"base_failed": bits.bitwiseAND(F.lit(BASE).cast("long")) != 0, "kept": (bits.bitwiseAND(F.lit(policy.hard).cast("long")) == 0) & (soft <= policy.most_soft)})


def ablations(ledger: DataFrame, policy: Policy = POLICIES[DEFAULT]) -> DataFrame:
    """For each hard or soft rule: rows that fail it, rows kept again if the policy dropped it alone, and all rows.

    A row comes back only if the rest of the policy keeps it: no other hard rule fails and few
    enough soft ones do. One pass with a fixed set of sums over bits; an empty ledger gives zeros.
    """
    used = [(name, BIT[name]) for name, _ in RULES if (policy.hard | policy.soft) & BIT[name]]
    bits = F.col("failed_bits")
    passes = lambda bits, p: (bits.bitwiseAND(F.lit(p.hard).cast("long")) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(p.soft).cast("long"))) <= p.most_soft)
    back = lambda b: ~passes(bits, policy) & passes(bits.bitwiseAND(F.lit(~b).cast("long")), policy)
    sums = [F.count_if(bits.bitwiseAND(F.lit(b).cast("long")) != 0).alias(f"f{i}") for i, (_, b) in enumerate(used)] + [F.count_if(back(b)).alias(f"a{i}") for i, (_, b) in enumerate(used)]
    one = ledger.agg(F.count(F.lit(1)).alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"a{i}").alias("n_only"), F.col("n").alias("n_rows")) for i, (name, _) in enumerate(used)]))
    return one.select(rows.alias("r")).select("r.*")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = POLICIES[DEFAULT]) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns."""
    # The row goes along as one value, so that none of its columns clashes with a measurement.
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("__row"), F.col(id_col).alias("__given_id"), F.col(text_col).alias("__given_text"))
    ledger = apply_policy(measure(rows, "__given_id", "__given_text", carry=["__row"]), policy)
    # Counting rows here also keeps the filter above the measurements: pushed below, it would work them out anew for each use.
    counted = ledger.observe(f"quality_rules_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"), F.count_if("kept").alias("kept"))
    return counted.where("kept").select("__row.*")


#: The measurements in DuckDB, over view ``documents``.
_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM t) GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, d.text, len(w.ws)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_lines, (coalesce(l.n, 0) - coalesce(l.u, 0))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words, (length(d.text) - length(regexp_replace(d.text, '[.!?]', '', 'g')))::BIGINT AS n_sentence_ends
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid)),
b AS (SELECT *, (""" + " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES) + """)::BIGINT AS failed_bits FROM m)
"""


def ledger_sql(policy: Policy = POLICIES[DEFAULT]) -> str:
    return _LEDGER_SQL + f"SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_sentence_ends, failed_bits, (failed_bits & {BASE}) <> 0 AS base_failed, (failed_bits & {policy.hard}) = 0 AND bit_count(failed_bits & {policy.soft}) <= {policy.most_soft} AS kept FROM b"
