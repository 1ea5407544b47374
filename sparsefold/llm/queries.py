"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, chat, collocations, decontaminate, importance, jaccard, licenses, mixing, quality, repeats, sharding, surrogates, token_counts
from .store import table

#: The key of the registered query; a real run takes its own.
KEY = b"registered query"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode("text", "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    got = sharding.shard(docs, shards=16)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), max_repeats=1.5).select("doc_id", "source", *mixing.OUTPUT)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("doc_id", *quality.BASE, "kept", *quality.MEASURES)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digest(chat.format_conversations(rows))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_pairs.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_surrogates, op3_mixing, op4_decontamination, op5_token_counts, op6_jaccard, op7_quality_rules, op8_licenses, op9_repeats, op10_chat, op11_collocations, op12_byte_bpe, op13_importance)}
ORACLES = {"op6_jaccard": jaccard.ORACLE_SQL, "op7_quality_rules": quality.ORACLE_SQL, "op8_licenses": licenses.ORACLE_SQL, "op9_repeats": repeats.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op13_importance": importance.ORACLE_SQL}
