"""Token counts kept by deltas.

A batch of changes is turned into signed deltas: an insert adds a document's counts, a delete
takes them back, a revision does both. A commit adds a batch up by source, language and
tokenizer version, writes that to a folder of its own and then enters the folder in a
manifest, by one rename that fails if the batch is there already. Only folders in the
manifest are read, so a lost attempt leaves nothing behind that counts, and a batch committed
again changes nothing. Totals are sums over the committed folders, whatever their order.

Totals are maintained: a snapshot holds the sums of all batches up to it, and the manifest
only those since. Reading totals opens one snapshot and ``COMPACT_AT`` batches or few more,
however many have ever been committed. A batch that a snapshot covers stays known by name.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe
from lodestone.scratch import keep

#: Batches in the manifest at which a commit makes a snapshot of them.
COMPACT_AT = 50
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"

#: Tokenizer versions that a pattern's matches make, valid in Java's and RE2's syntax.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def counts(docs: DataFrame, tokenizer: str, n_tokens: Column | None = None, text_col: str = "text") -> DataFrame:
    """The columns of a delta for each row of ``docs``: keys, one document, its tokens and characters.

    ``n_tokens`` counts a row's tokens; without it the named pattern does. Null texts count as
    empty. Null sources and languages stay null and form groups of their own. Rows that repeat
    a document, and those without id, count each; other columns than source, lang and the
    text aren't read. Whole texts are counted, however long.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n = F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])) if n_tokens is None else F.coalesce(n_tokens, F.lit(0))
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), n.cast("long").alias("n_tokens"), F.length(text).cast("long").alias("n_chars"))


def bpe_counts(docs: DataFrame, vocabulary: bpe.Vocabulary, tokenizer: str, text_col: str = "text") -> DataFrame:
    """As ``counts``, under a byte-level BPE vocabulary: its name is the tokenizer version."""
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), "source", "lang", F.col(text_col).cast("string").alias("text")), "ledger-rows")
    encoded = bpe.encode(rows, vocabulary, "row").select("row", "n_tokens")
    return counts(rows.join(encoded, "row"), tokenizer, F.col("n_tokens"))


def signed(delta: DataFrame, sign: int) -> DataFrame:
    return delta.select(*KEYS, *[(F.lit(sign) * F.col(c)).alias(c) for c in SUMS])


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The delta of counts that replace others."""
    return signed(old, -1).unionByName(signed(new, 1))


def rolled_up(delta: DataFrame) -> DataFrame:
    return delta.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Ledger:
    """Committed batches under a folder: data in folders of their own, named by a manifest of one file a batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._at(path).getFileSystem(self._conf)

    def _entry(self, batch: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9._-]+", batch):
            raise ValueError("a batch's name has letters, digits, dots, dashes and underscores")
        return f"{self.path}/manifest/{batch}.json"

    def _read(self, path: str) -> dict:
        stream = self._files(path).open(self._at(path))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _enter(self, batch: str, entry: dict) -> bool:
        """Name a batch in the manifest; false if another writer was first."""
        return self._entered(self._entry(batch), entry)

    def _entered(self, name: str, entry: dict) -> bool:
        """A file written aside and renamed; false if the name is taken."""
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        stream = self._files(aside).create(self._at(aside), True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        place = self._at(name)
        self._files(aside).mkdirs(place.getParent())
        names = self._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(names.Options.Rename, 1)
        none[0] = names.Options.Rename.NONE
        try:
            names.FileContext.getFileContext(self._at(aside).toUri(), self._conf).rename(self._at(aside), place, none)
        except Exception:
            if not self._files(name).exists(place):
                raise
            return False
        return True

    def committed(self, batch: str) -> bool:
        return self._place_of(batch) is not None

    def _place_of(self, batch: str) -> str | None:
        """The file that names a batch: in the manifest, or among those that a snapshot covers."""
        places = self._entry(batch), f"{self.path}/covered/{batch}.json", self._entry(batch)  # it may move meanwhile
        return next((p for p in places if self._files(self.path).exists(self._at(p))), None)

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Write a batch unless it was committed before.

        A batch sent again must have the same sums: others under its name are an error. Of two
        writers at once one enters its folder; the other's is not read.
        """
        place = f"{self.path}/data/{batch}-{uuid.uuid4().hex}"
        self._entry(batch)
        rolled_up(delta).write.parquet(place)
        sums = F.sum(F.xxhash64(*KEYS, *SUMS).cast("decimal(38,0)"))
        digest = str(self.spark.read.schema(SCHEMA).parquet(place).agg(sums.alias("x")).first().x)
        fresh = not self.committed(batch) and self._enter(batch, {"folder": place, "digest": digest})
        if not fresh:
            self._files(place).delete(self._at(place), True)
            if self._read(self._place_of(batch))["digest"] != digest:
                raise ValueError(f"batch {batch} was committed with other sums")
        elif len(self._names("manifest")) >= COMPACT_AT:
            self.compact()
        return fresh

    def _names(self, kind: str) -> list[str]:
        top = f"{self.path}/{kind}"
        files = self._files(top)
        return sorted(x.getPath().getName().removesuffix(".json") for x in files.listStatus(self._at(top))) if files.exists(self._at(top)) else []

    def _snapshot(self) -> tuple[int, dict]:
        """The newest snapshot: its number, the folder of its sums, and the batches that it was the first to cover."""
        names = self._names("snapshots")
        return (int(names[-1]), self._read(f"{self.path}/snapshots/{names[-1]}.json")) if names else (0, {"folder": None, "covers": []})

    def _live(self) -> tuple[int, dict, list[str]]:
        """The newest snapshot and the batches since, as of one moment."""
        while True:
            number, snapshot = self._snapshot()
            since = sorted(set(self._names("manifest")) - set(snapshot["covers"]))
            if self._snapshot()[0] == number:  # else batches may have moved between the two looks
                return number, snapshot, since

    def folders(self) -> list[str]:
        """The folders whose sums are the totals: the snapshot's, and those of the batches since."""
        while True:
            number, snapshot, since = self._live()
            try:
                found = [self._read(self._entry(b))["folder"] for b in since]
            except Exception:
                if self._snapshot()[0] == number:
                    raise
                continue
            return [f for f in [snapshot["folder"]] if f] + found

    def compact(self) -> bool:
        """Make a snapshot of the totals; false if there is nothing new or another writer was first.

        The snapshot is entered before the covered batches leave the manifest, and names them, so
        that no reader counts one twice or not at all; a writer lost in between leaves moves that
        the next one makes.
        """
        number, snapshot, since = self._live()
        self._move(snapshot["covers"])
        if not since:
            return False
        found = [snapshot["folder"]] if snapshot["folder"] else []
        place = f"{self.path}/data/snapshot-{uuid.uuid4().hex}"
        rolled_up(self.spark.read.schema(SCHEMA).parquet(*found, *[self._read(self._entry(b))["folder"] for b in since])).write.parquet(place)
        if not self._entered(f"{self.path}/snapshots/{number + 1:09d}.json", {"folder": place, "covers": since}):
            self._files(place).delete(self._at(place), True)
            return False
        self._move(since)
        return True

    def _move(self, batches: list[str]) -> None:
        files = self._files(self.path)
        files.mkdirs(self._at(f"{self.path}/covered"))
        for b in batches:
            if files.exists(self._at(self._entry(b))):
                files.rename(self._at(self._entry(b)), self._at(f"{self.path}/covered/{b}.json"))

    def vacuum(self, hours: float = 24.0) -> int:
        """Remove data folders older than ``hours`` that nothing names: those of lost writers and of covered batches."""
        import time

        live, files = {f.rpartition("/")[2] for f in self.folders()}, self._files(self.path)
        top = self._at(f"{self.path}/data")
        old = [x.getPath() for x in files.listStatus(top) if x.getPath().getName() not in live and x.getModificationTime() <= (time.time() - 3600 * hours) * 1000] if files.exists(top) else []
        return sum(bool(files.delete(x, True)) for x in old)

    def batches(self) -> DataFrame:
        """The sums of the snapshot and of the batches since, a delta each."""
        found = self.folders()
        return self.spark.read.schema(SCHEMA).parquet(*found) if found else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        """Totals by source, language and tokenizer; groups without documents left are not listed."""
        return rolled_up(self.batches()).where("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")


def modulo(id_col: str, by: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.col(id_col), F.lit(by)) == rest, F.lit(False))


def replayed(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Totals after four commits over all of ``docs``, one of them sent twice.

    All documents are inserted under the first tokenizer; those whose id leaves 3 by 7 are
    deleted; those left whose id leaves 1 by 5 are counted anew under the second tokenizer in
    place of the first; then the deletion is sent again. A snapshot is made after the second.
    """
    ledger = Ledger(docs.sparkSession, path)
    first = counts(docs, "words-1")
    gone = modulo(id_col, 7, 3)
    moved = docs.where(~gone & modulo(id_col, 5, 1))
    deletion = signed(counts(docs.where(gone), "words-1"), -1)
    ledger.commit("insert-1", first)
    ledger.commit("delete-1", deletion)
    ledger.compact()
    ledger.commit("revise-1", revised(counts(moved, "words-1"), counts(moved, "words-2")))
    ledger.commit("delete-1", deletion)
    return ledger.totals()


REPLAYED_SQL = rf"""
WITH d AS (SELECT source, lang, coalesce(text, '') AS text, CASE WHEN coalesce(doc_id % 5 = 1, false) THEN 'words-2' ELSE 'words-1' END AS tokenizer
  FROM documents WHERE NOT coalesce(doc_id % 7 = 3, false))
SELECT source, lang, tokenizer, count(*) AS n_docs, sum(CASE WHEN tokenizer = 'words-1' THEN len(regexp_extract_all(text, '{TOKENIZERS["words-1"]}')) ELSE len(regexp_extract_all(text, '{TOKENIZERS["words-2"]}')) END)::BIGINT AS n_tokens,
  sum(length(text))::BIGINT AS n_chars FROM d GROUP BY ALL
"""
