"""The operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rinsework.session import Staging

from . import bagminhash, chat, codes, lines, mixing, packing, quality, secret, sketch, spelling, subspace, toxicity, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _settled(result: DataFrame, staging: Staging) -> DataFrame:
    """The result as a written table, without the tables that led to it."""
    written = staging.write(result, "result")
    staging.discard(keep=("result",))
    return written


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_repeated_lines(_table(spark, folder, "documents"), Staging(spark))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    return _settled(bagminhash.near_duplicates(_table(spark, folder, "documents"), staging), staging)


def op4_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    return _settled(subspace.near_vectors(_table(spark, folder, "embeddings"), staging), staging)


def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = staging.write(chat.chains(rows), "messages")
    return _settled(chat.digests(chat.conversations(messages, staging)), staging)


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return secret.scan(docs, secret.train(docs))


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    found = mixing.mix(_table(spark, folder, "documents"), staging)
    return _settled(found.select("doc_id", "size", "source_size", "target", "taken"), staging)


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    return _settled(urls.verdicts(_table(spark, folder, "pages"), staging), staging)


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    return _settled(packing.pack(_table(spark, folder, "documents"), staging), staging)


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    ranges = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return sketch.fingerprints(_table(spark, folder, "documents"), ranges)


def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    scored = quality.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"), staging)
    return _settled(scored, staging)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    return _settled(spelling.variants(_table(spark, folder, "documents"), staging), staging)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    staging = Staging(spark)
    return _settled(codes.compress(_table(spark, folder, "embeddings"), staging), staging)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_toxicity, op2_line_dedup, op3_minhash_near_dedup, op4_embedding_near_dedup, op5_chat_formatting,
        op6_secret_scan, op7_source_mixing, op8_url_filter, op9_best_fit_packing, op10_fingerprints, op11_quality, op12_spelling_variants, op13_vector_codes,
    )
}
