"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexicon: insults, threats, targets, negations, reporting verbs, and
clause ends. Five small transducers read the symbols of a clause and weigh what they pass on:
an insult counts more near a target, less in the scope of a negation or in reported speech;
a threat counts when a target follows it. They are composed once into a single machine, which
scores whole matched clauses. The lexicon of insults has fixed common words and stems learned
from labelled texts (a stem is itself a two-state machine: its letters, then any ending): likelier
in the toxic texts of both halves of the sample, two at least in each, with several words that begin so, none of them
a word of the lexicon. The clause weights of a text are turned into a probability by a logistic fit.

The fit and the stems come from a bounded sample of labelled rows (``MOST_LABELLED``), taken
by hash; equal texts with equal labels count once in it. All texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import keep

#: Labelled training rows used for the stems and the fit, at most; by the order of a hash of the id.
MOST_LABELLED = 20_000
THRESHOLD = 0.3
#: Lengths of the stems tried, besides whole words: shorter ones begin ordinary words too.
STEM = range(4, 9)
#: A stem stands for words that begin so only if toxic texts have so many different ones.
FORMS = 3
#: How much likelier (as a logarithm) a stem must be in toxic texts of each half of the sample, so that chance in one doesn't count.
LEAST_IN_HALF = 1.0
#: A stem is used if it is this many times likelier (as a logarithm) in toxic texts.
LEAST_LOG_ODDS = 2.5
#: The log odds that count as a full insult; weaker stems count in proportion.
FULL_LOG_ODDS = 7.0
#: Words remembered by a task with their symbols before it begins anew.
MEMO = 400_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
SYMBOLS = range(7)

# Common words of the classes in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid dumb fool loser losers trash scum worthless pathetic disgusting clown garbage filth vermin imbecile jerk dummkopf trottel abschaum depp crétin imbécile connard ordure estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy beat crush burn shoot stab töten vernichten schlagen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself u ye du dich dir euch ihr tu te toi vous usted ustedes vosotros they them he she him her".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't nicht kein keine nie niemals ne pas jamais ni nunca jamás".split()
REPORTS = "said says say told wrote called quoted claimed reported sagte schrieb behauptete dit écrit déclaré dijo escribió llamó".split()

_TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]+")
_APOSTROPHES = str.maketrans("\u2019\u02bc\u2018", "'''")


@dataclass
class Transducer:
    """``step(state, symbol)`` gives the next state, the symbol passed on and the weight of the arc."""

    states: int
    step: Callable[[int, int], tuple[int, int, float]]

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one passes on is read by the other; weights multiply."""

        def step(state: int, symbol: int) -> tuple[int, int, float]:
            a, out, x = self.step(state // other.states, symbol)
            b, out, y = other.step(state % other.states, out)
            return a * other.states + b, out, x * y

        return Transducer(self.states * other.states, step)


def _scope(opens: int, width: int, on: int, inside: float, outside: float = 1.0, to_end: bool = False) -> Transducer:
    """Weighs symbol ``on`` within ``width`` tokens after ``opens`` (or up to the clause's end)."""

    def step(state: int, symbol: int) -> tuple[int, int, float]:
        if symbol == END:
            return 0, symbol, 1.0
        if symbol == opens:
            return width, symbol, 1.0
        weight = 1.0 if symbol != on else inside if state else outside
        return state if to_end else max(0, state - 1), symbol, weight

    return Transducer(width + 1, step)


def grammar() -> list[list[tuple[int, float]]]:
    """The composed machine as a table: [state][symbol] gives the next state and the weight (0: nothing counted)."""
    target = _scope(TARGET, 4, INSULT, 1.5)
    threat = _scope(THREAT, 4, TARGET, 2.0, 0.0)
    negation = _scope(NEGATION, 3, INSULT, 0.4)
    report = _scope(REPORT, 1, INSULT, 0.6, to_end=True)
    insult = Transducer(1, lambda state, symbol: (0, symbol, 1.0 if symbol in (INSULT, TARGET) else 0.0))
    whole = threat.then(target).then(negation).then(report).then(insult)
    return [[whole.step(state, symbol)[::2] for symbol in SYMBOLS] for state in range(whole.states)]


_FIXED = {w: s for words, s in ((INSULTS, INSULT), (THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)) for w in words}


@dataclass
class Model:
    """Learned stems ("abc": words that begin so, "abc$": the word), and the logistic weights."""

    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0
    slope: float = 2.0

    def symbol(self, word: str) -> int:
        fixed = _FIXED.get(word, OTHER)
        if fixed:
            return fixed
        if word[0] in ".!?;\n":
            return END
        return INSULT if self.odds(word) else OTHER

    def odds(self, word: str) -> float:
        """Of the stems that match a word, the highest log odds; zero without one."""
        return max([self.stems.get(f"{word}$", 0.0), *(self.stems.get(word[:n], 0.0) for n in STEM if n <= len(word))])

    def weight(self, word: str) -> float:
        """The weight of the word's own arc: one, or less for a weak learned stem."""
        return 1.0 if word in _FIXED else min(1.0, self.odds(word) / FULL_LOG_ODDS)

    def score(self, weight: float) -> float:
        return 1 / (1 + math.exp(-(self.bias + self.slope * math.log1p(weight))))


class _Symbols(dict):
    """Symbols of words, worked out once for each word."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = out = self.model.symbol(word)
        return out


def tokens(text: str | None) -> list[str]:
    """Lower-cased words and clause ends; apostrophes of all kinds are one."""
    return _TOKENS.findall((text or "").lower().translate(_APOSTROPHES))


def clause_weights(text: str | None, symbols: _Symbols, machine: list[list[tuple[int, float]]]) -> list[float]:
    """The weights of the clauses of a text that the grammar matches."""
    words = tokens(text)
    found = [symbols[w] for w in words]
    if INSULT not in found and THREAT not in found:
        return []
    out, state, clause = [], 0, 0.0
    for w, s in zip([*words, ""], [*found, END]):
        state, weight = machine[state][s]
        clause += weight * symbols.model.weight(w) if weight else 0.0
        if s == END and clause:
            out.append(clause)
            clause = 0.0
    return out


def features(text: str) -> set[str]:
    """The stems and whole words of a text, without the words that the lexicon has: their beginnings say nothing."""
    words = {w for w in tokens(text) if w[0] not in ".!?;\n" and w not in _FIXED}
    return {w + "$" for w in words} | {w[:n] for w in words for n in STEM if n <= len(w)}


def is_held_out(id_: Column) -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, y): a bounded sample of labelled training texts; equal texts count once for each label.

    An id has one text, the least by name where ``docs`` repeats it, so there are ``most`` rows at most.
    """
    some = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~is_held_out(F.col("id")))
    some = some.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(some), "id")
    return texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y").distinct()


def _counted(texts: DataFrame, wanted: set[str] | None) -> DataFrame:
    """(feature, n): in how many texts each feature is; each task adds up before the shuffle."""
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter = Counter()
            for t in batch.column(0).to_pylist():
                found = features(t)
                count.update(found if sent.value is None else found & sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(count.keys()), pa.string()), pa.array(list(count.values()), pa.int64())], names=["feature", "n"])

    return texts.select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _chosen(incidence: dict[str, set[int]], odds: dict[str, float], least: int, times: int = 2) -> dict[str, float]:
    """Stems by greedy cover: each adds the most texts not yet covered ``times`` times."""
    need: dict[int, int] = defaultdict(lambda: times)
    out: dict[str, float] = {}
    order = sorted(incidence)
    while order:
        best = max(order, key=lambda f: (sum(need[d] > 0 for d in incidence[f]) * odds[f] ** 2, -len(f), f))
        if sum(need[d] > 0 for d in incidence[best]) < least:
            break
        out[best] = odds[best]
        for d in incidence[best]:
            need[d] -= 1
        stem = best.rstrip("$")
        order = [f for f in order if f != best and not f.startswith(stem) and not stem.startswith(f)]
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge."""
    w = np.zeros(2)
    a = np.stack((np.ones(len(x)), x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MOST_LABELLED) -> Model:
    """The model from the labelled rows that aren't held out.

    Without labelled rows of both kinds the fixed words and default weights are used.
    Nothing but texts and labels is read.
    """
    sample = keep(labelled_sample(docs, labels, id_col, text_col, label_col, most), "toxicity-sample")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        return Model()
    least = max(3, positive // 300)
    toxic, clean = sample.where("y = 1"), sample.where("y = 0")
    log_odds = lambda n, m, p, q: math.log((n + 0.5) / (p + 1)) - math.log((m + 0.5) / (q + 1))
    seen = {r.feature: r.n for r in _counted(toxic, None).where(F.col("n") >= least).collect()}
    against = {r.feature: r.n for r in _counted(clean, set(seen)).collect()}
    odds = {f: o for f, n in seen.items() if (o := log_odds(n, against.get(f, 0), positive, negative)) >= LEAST_LOG_ODDS}
    for half in (0, 1):
        part = F.pmod(F.xxhash64("text"), F.lit(2)) == half
        in_toxic, in_clean = ({r.feature: r.n for r in _counted(x.where(part), set(odds)).collect()} for x in (toxic, clean))
        p, q = toxic.where(part).count(), clean.where(part).count()
        odds = {f: o for f, o in odds.items() if in_toxic.get(f, 0) >= 2 and log_odds(in_toxic[f], in_clean.get(f, 0), p, q) >= LEAST_IN_HALF}
    if odds:
        stems = sample.sparkSession.createDataFrame([(f,) for f in odds if not f.endswith("$")], "stem string")
        words = _counted(toxic, None).where(F.col("feature").endswith("$")).select(F.rtrim("feature", F.lit("$")).alias("w"))
        begun = words.select(F.explode(F.array(*[F.left("w", F.lit(n)) for n in STEM])).alias("stem"), "w").where("stem <> w").join(F.broadcast(stems), "stem")
        forms = {r.stem: r.n for r in begun.groupBy("stem").agg(F.countDistinct("w").alias("n")).collect()}
        odds = {f: o for f, o in odds.items() if f.endswith("$") or forms.get(f, 0) >= FORMS}
    strong = set(odds)
    sent = docs.sparkSession.sparkContext.broadcast(strong)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(features(t) & sent.value) for t in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["found"])

    incidence: dict[str, set[int]] = defaultdict(set)
    for d, row in enumerate(toxic.select("text").mapInArrow(held, "found array<string>").collect()):
        for f in row.found:
            incidence[f].add(d)
    model = Model(_chosen(incidence, odds, least))
    weights = _scored(sample.select("text", "y"), "text", Model(model.stems, 0.0, 1.0), "y").select("y", "weight").collect()
    x, y = np.array([math.log1p(r.weight) for r in weights]), np.array([r.y for r in weights], float)
    model.bias, model.slope = fit_logistic(x, y)
    return model


def _scored(docs: DataFrame, text_col: str, model: Model, *others: str) -> DataFrame:
    """``others``, weight, clauses: the total weight of matched clauses and their number."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col(text_col).cast("string").alias("__text"), *others)
    schema = ", ".join([*(f"`{c}` {given.schema[c].dataType.simpleString()}" for c in others), "weight double, clauses long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, machine = _Symbols(sent.value), grammar()
        for batch in batches:
            found = [clause_weights(t.as_py(), symbols, machine) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([math.fsum(f) for f in found], pa.float64()), pa.array([len(f) for f in found], pa.int64())], names=[*others, "weight", "clauses"])

    return given.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted, weight, clauses) for each row; null and empty texts get the score of no clause."""
    weighed = _scored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", model, "id")
    p = 1 / (1 + F.exp(-(F.lit(model.bias) + F.lit(model.slope) * F.log1p("weight"))))
    out = weighed.withColumn("score", p).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), "score", "predicted", "weight", "clauses")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, machine = _Symbols(sent.value), grammar()
        for batch in batches:
            yield batch.filter(pa.array([sent.value.score(math.fsum(clause_weights(t.as_py(), symbols, machine))) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
