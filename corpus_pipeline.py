"""A corpus pipeline of five stages over ``documents``.

Quality rules, toxicity and near copies remove documents, benchmark passages remove the
documents that hold them, and the texts left are encoded. Each stage reads what its
predecessor kept, written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, quality, simhash, toxicity
from lodestone.llm.registry import table, vocabulary
from lodestone.scratch import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps. Null and empty texts have no words and go; each row that repeats is judged by itself; other columns are carried on."""
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Null texts count as empty and stay, rows without id too, which are never trained on; no label or an empty table leaves the fixed lexicon."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of rows that share it, the least as JSON. Texts without words, null ones too, are copies of one another; rows without id all stay."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts and items match nothing; rows are tested by their own text, whatever their ids; without items all stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and the digest of what they decode to, a row for each row; null texts count as empty and have no ids."""
    encoded = bpe.encode(docs, vocabulary(), decoded=True)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality_rules), ("toxicity", not_toxic), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: The grammar, the fingerprints and the merges can't be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
