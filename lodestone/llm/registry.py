"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, byte_cnn, changes, chat, decontaminate, hmm_lm, license_scan, quality, resample, simhash, token_rollup, toxicity, warc
from lodestone.scratch import new_path
from lodestone.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


@cache
def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> bpe.Vocabulary:
    """A rank file of the installed public tokenizers, read once by the driver."""
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.replayed(table(spark, sf_dir, "documents"), new_path(spark, "token-ledger"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select(F.col("source_id").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", F.octet_length("block").alias("content_length"), F.decode("block", "utf-8").alias("block"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_policy(quality.measure(table(spark, sf_dir, "documents")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "weight", "clauses")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_cnn.train(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.score(docs, net).select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "chunks")


def op13_sequenced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.applied(table(spark, sf_dir, "client_changes"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_token_rollup": op2_token_rollup,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_hidden_markov_lm": op7_hidden_markov_lm,
    "op8_toxicity": op8_toxicity,
    "op9_perspective_rotation": op9_perspective_rotation,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_sequenced_changes": op13_sequenced_changes,
}

ORACLE: dict[str, str] = {
    "op2_token_rollup": token_rollup.REPLAYED_SQL,
    "op9_perspective_rotation": chat.ROTATE_SQL,
    "op4_quality_rules": quality.ledger_sql(),
    "op11_importance_resampling": resample.RESAMPLE_SQL,
}
