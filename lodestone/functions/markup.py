"""Markup that regular expressions can't read: HTML to Markdown, Markdown keywords, balanced JSON.

These run on Arrow batches; everything else in the library stays in Spark's own functions.
"""

from __future__ import annotations

import decimal
import json
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links, images, bold, emphasis and code."""

    hidden = {"script", "style", "head", "noscript"}
    marks = {"strong": "**", "b": "**", "em": "_", "i": "_", "code": "`"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.href: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in self.hidden:
            self.skipped += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "ul", "ol", "article", "section", "table", "pre"):
            self.out.append("\n\n")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "img":
            self.out.append(f"![{given.get('alt') or ''}]({given.get('src') or ''})")
        elif tag == "a":
            self.href.append(given.get("href") or "")
            self.out.append("[")
        elif tag in self.marks:
            self.out.append(self.marks[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in self.marks:
            self.out.append(self.marks[tag])
        elif re.fullmatch("h[1-6]|p|div|ul|ol|pre|table", tag):
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown_of(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    text = "".join(parser.out)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(line.strip() for line in text.split("\n"))).strip()


def balanced_json(text: str | None) -> str | None:
    """The first JSON object, in a code fence or bare, by its balanced braces."""
    fence = re.search(r"```(?:json)?\s*(\{.*?\})\s*```", text or "", re.S)
    body = fence[1] if fence else text or ""
    start, depth, quoted, escaped = body.find("{"), 0, False, False
    for i in range(max(start, 0), len(body) if start >= 0 else 0):
        c = body[i]
        if quoted:
            quoted, escaped = c != '"' or escaped, c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                try:
                    json.loads(body[start : i + 1])
                except ValueError:
                    return None
                return body[start : i + 1]
    return None


# The longest run of words taken from a heading of each level.
_GRAMS = {1: 4, 2: 3, 3: 2, 4: 2, 5: 1, 6: 1}
# A run of letters and digits that no separator follows begins no compound, nor does any part of it: it is gone through once, not once for each place in it.
_COMPOUND = re.compile("(?<![A-Za-z0-9])" + X.COMPOUND.replace("9]+", "9]++"))
_WORD, _DIGITS = re.compile(X.WORD), re.compile(X.DIGITS)
_BASE = re.compile("[a-z]{3,}")
#: Distinct words that a task remembers at once.
MOST_SEEN = 1 << 18
_SKIP = frozenset(X.SKIP_WORDS)
_HUMPS = re.compile("([a-z0-9])([A-Z])"), re.compile("([A-Z]+)([A-Z][a-z])")
_CAMEL, _CAPS, _SNAKE, _NAMES, _SINGLE = (re.compile(p, re.A) for p in (X.CAMEL, X.CAPS, X.SNAKE, X.NAMES, X.SINGLE))
_SPAN = re.compile(r"^[a-zA-Z][a-zA-Z0-9_.-]{1,63}$")
_FENCE = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n(.*?)(?:^ {0,3}\1[`~]*[ \t]*$|\Z)")
_HEADING = re.compile(r"(?m)^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$|^(?! {0,3}#)([^\n]+)\n {0,3}(=+|-+)[ \t]*$")
_INLINE = re.compile(r"(?s)\*\*(?=\S)(.+?)(?<=\S)\*\*|(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)|(`+)(?!`)(.+?)(?<!`)\3(?!`)")


def _valid(word: str) -> bool:
    return 2 <= len(word) <= 64 and word not in _SKIP and re.search("[a-z]", word) is not None


@lru_cache(1 << 16)
def _parts(word: str) -> list[str]:
    """A word as tokens: its humps if it has any, else itself."""
    if re.search("[A-Z]", word) and re.search("[a-z]", word):
        return [w for w in _HUMPS[1].sub(r"\1 \2", _HUMPS[0].sub(r"\1 \2", word)).lower().split() if _valid(w)]
    return [w for w in word.lower().split("_") if w and _valid(w)]


def words_of(text: str) -> list[str]:
    """As ``text.words`` does for columns: compounds with their parts, words, digits."""
    out = []
    for compound in _COMPOUND.findall(text):
        out.append(compound.lower())
        if re.fullmatch(r"[0-9]+\.[0-9]+", compound):
            continue
        for part in filter(None, re.split("[-_.+/]", compound)):
            out += ([part] if 2 <= len(part) <= 64 else []) if re.fullmatch("[0-9]+", part) else _parts(part)
    for word in _WORD.findall(text):
        if word[1:].islower() and "_" not in word:  # without humps, as most are: taken as it is, since a large vocabulary would not find its words in the cache
            low = word.lower()
            if len(low) <= 64 and low not in _SKIP:
                out.append(low)
        else:
            out += _parts(word)
    return out + _DIGITS.findall(text)


# As Java reads them: only ASCII counts in classes and cases, and an end may stand before the last line's terminator.
_PATTERNS = [(n, re.compile(re.sub(r"\$$", lambda _: r"(?=(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z)", p).replace(r"\b", r"(?u:\b)"), re.I | re.A)) for n, p in X.PATTERNS]
_SEPARATED, _PHONE, _PATTERN_LIKE = re.compile(X.SEPARATORS), re.compile(X.PHONE.replace(r"\d", "[0-9]")), re.compile(X.PATTERN_LIKE)
_STRUCTURE, _SPECIAL = re.compile("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"), frozenset("\\.^$|?*+()[]{}")


def structure_of(token: str) -> str:
    """As ``text.structural_pattern`` does for columns."""
    out = []
    for run in _STRUCTURE.findall(token):
        first = run[0]
        out.append("[A-Za-z]" if first in string.ascii_letters else r"\d" if first in string.digits else "\\" + first if first in _SPECIAL else first)
        if len(run) > 1:
            out.append(f"{{{len(run)}}}")
    return "".join(out)


def _rounded(number: str, digits: int) -> str | None:
    with decimal.localcontext(prec=10_000, rounding=decimal.ROUND_HALF_UP):
        value = decimal.Decimal(number).quantize(decimal.Decimal("1e-18"))
        return f"{value.quantize(decimal.Decimal(f'1e-{digits}')):f}" if value < 10**20 else None


@lru_cache(1 << 16)
def pattern_forms(token: str) -> tuple[str | None, ...]:
    """As ``text.pattern_synonyms`` does for columns."""
    out: list[str | None] = []
    number = re.fullmatch(r"[0-9]+\.([0-9]{2,})", token)
    if number:
        out += [token.split(".")[0], _rounded(token, 1), _rounded(token, 2)] + ([_rounded(token, 3)] if len(number[1]) >= 3 else [])
    if len(re.findall("[0-9]", token)) >= 3 or _SEPARATED.search(token):
        out.append(structure_of(token))
    for name, pattern in _PATTERNS:
        if pattern.search(token):
            out += [name.lower(), token.replace("/", "-")] if "DATE" in name else [name.lower()]
    if re.search("[A-Z][a-z]+(?:[A-Z][a-z]+)+", token):
        out.append(re.sub("([a-z])([A-Z])", r"\1-\2", token).lower())
    if re.search("[a-z0-9]+(?:_[a-z0-9]+)+", token):
        out.append(token.replace("_", "-"))
    if _PHONE.search(token):
        out.append(token.replace(".", "-"))
    return tuple(out)


@lru_cache(1 << 16)
def synonym_slot(token: str | None) -> int:
    """As ``text.gram_slot_synonym`` does for columns."""
    if token is None:
        return 1
    words = len(re.split(" +", token.strip(" ")))
    if words > 1:
        return min(words, 4)
    if _PATTERN_LIKE.search(token):
        outside = re.sub(r"\[[^\]]*\]?", "", re.sub(r"\\.", "", token))
        return min(outside.count("-") + outside.count("/") + 1, 4)
    return 1 if re.fullmatch(r"[0-9]+\.[0-9]+", token) else min(max(1, len([p for p in re.split("[-_.+/]", token) if p])), 4)


def runs(words: list[str], least: int, most: int) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(least, min(most, len(words)) + 1) for i in range(len(words) - n + 1)]


def identifiers(text: str) -> Iterator[str]:
    """Keywords from compounds, camel case, capitals, snake case and names of several capitalised words."""
    for compound in _COMPOUND.findall(text):
        yield compound.lower()
        parts: list[str] = []
        for part in filter(None, re.split("[-_.+/]", compound)):
            if re.fullmatch("[0-9]+", part):
                parts += [part] if len(part) >= 2 else []
            else:
                parts += [w for w in dict.fromkeys(words_of(part)) if w not in parts]
        yield from runs(parts, 1, 4)
    for word in _CAMEL.findall(text):
        yield from runs(words_of(word), 1, 3)
    for found, always in ((_CAPS, True), (_SNAKE, False)):
        for word in found.findall(text):
            if always:
                yield word.lower()
            if "_" in word:
                yield from runs([w for w in word.lower().split("_") if len(w) >= 2 and w not in _SKIP], 1, 3)
    for name in dict.fromkeys(x.strip() for found in (_NAMES, _SINGLE) for x in found.findall(text)):
        words = words_of(name)
        yield from runs(words, 2, 4) if len(words) > 1 else words


def keywords_of(markdown: str | None) -> list[str]:
    """Distinct keywords by what marks them, in order: headings (longer runs the higher), bold text, code, and identifiers anywhere."""
    text = (markdown or "").replace("\r\n", "\n")
    out: dict[str, None] = {}

    def marked(piece: str, most: int | None) -> None:
        out.update(dict.fromkeys(runs(words_of(piece), 1, most) if most else []))
        out.update(dict.fromkeys(identifiers(piece)))

    def inline(piece: str) -> None:
        for bold, under, _, code in _INLINE.findall(piece):
            if code:
                marked(code, None)
                if _SPAN.match(code.strip()):
                    out[code.strip().lower()] = None
            else:
                marked(bold or under, 3)

    def prose(piece: str) -> None:
        at = 0
        for h in _HEADING.finditer(piece):
            inline(piece[at : h.start()])
            title, level = (h[2] or "", len(h[1])) if h[1] else (h[3], 1 if h[4][0] == "=" else 2)
            marked(re.sub(r"!?\[([^\]]*)\]\([^)]*\)|[*`]", r"\1", title), _GRAMS[level])
            inline(title)
            at = h.end()
        inline(piece[at:])

    at = 0
    for fence in _FENCE.finditer(text):
        prose(text[at : fence.start()])
        marked(fence[2], None)
        at = fence.end()
    prose(text[at:])
    out.update(dict.fromkeys(identifiers(text)))
    return [k for k in out if len(k) >= 2]


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows whose texts have ``most`` bytes together, or one row: what is made of a batch of 10,000 long texts at once would fill a worker's memory."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and size + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _mapped(df: DataFrame, id_col: str, text_col: str, out_col: str, kind: pa.DataType, ddl: str, f) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f(t.as_py()) for t in part.column(1)], kind)], names=[id_col, out_col])

    given = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return given.mapInArrow(run, f"`{id_col}` long, `{out_col}` {ddl}")


def first_places(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): each text's distinct words (w, first_pos) with the place of the first."""

    def found(text: str | None) -> list[dict]:
        first: dict[str, int] = {}
        for i, w in enumerate(words_of(text or "")):
            first.setdefault(w, i)
        return [{"w": w, "first_pos": i} for w, i in first.items()]

    return _mapped(df, id_col, text_col, "words", pa.list_(pa.struct([("w", pa.string()), ("first_pos", pa.int32())])), "array<struct<w:string,first_pos:int>>", found)


def word_lists(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words): ``text.words`` on Arrow batches, for whole tables."""
    return _mapped(df, id_col, text_col, "words", pa.list_(pa.string()), "array<string>", lambda t: words_of(t or ""))


def base_words(df: DataFrame, text_col: str) -> DataFrame:
    """(w): the distinct words of three or more letters a to z in ``word_lists``, which the workers find before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        found: set[str] = set()
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py() or ""
                new = {*_WORD.findall(text), *(p for compound in _COMPOUND.findall(text) for p in re.split("[-_.+/]", compound))} - seen
                seen |= new
                found.update(w for x in new for w in _parts(x) if _BASE.fullmatch(w))
                if len(seen) > MOST_SEEN:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])
                    seen, found = set(), set()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["w"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(run, "w string").distinct()


def html_to_markdown(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return _mapped(df, id_col, html_col, "markdown", pa.string(), "string", markdown_of)


def markdown_keywords(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _mapped(df, id_col, text_col, "keywords", pa.list_(pa.string()), "array<string>", keywords_of)


def json_block(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _mapped(df, id_col, text_col, "block", pa.string(), "string", balanced_json)
