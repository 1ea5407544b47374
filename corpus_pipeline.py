"""Corpus pipeline: quality rules, near-duplicate join, decontamination, source mixing, sharding.

Each stage takes what its predecessor kept, written and read again, and returns the columns of ``documents``; the
last adds the shard and slot of each row. Mixing reads every document once and those of small sources up to 1.5 times,
so rows may repeat from there on. Stages hold no state: the tables that one writes for its result lie in the shared
folder, and ``run`` deletes them once that result is written.

Defined cases, by stage: documents without text or words fail the quality rules; null languages and sources are
groups of their own; rows that repeat a doc_id or have none are documents of their own where copies are sought;
an empty table or benchmark gives an empty result or leaves all; very long texts are read whole; columns beyond
those of ``documents`` are not carried, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsefold.llm import decontaminate, jaccard, mixing, quality, sharding
from sparsefold.llm.store import delete, noted, save, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
BROADCAST_IDS = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the fences of their language and source reject go."""
    return quality.quality_rules(docs.select(*COLUMNS), carry=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that with the least doc_id; documents without words are no copies.

    Where rows repeat a doc_id or have none, each row is a document of its own: they are numbered by doc_id, those
    without one last, then by the hash of their text, and the first of a group stays.
    """
    docs = docs.select(*COLUMNS)
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count():
        ordered = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64("text"))
        rows = save(ordered.withColumn("_row", F.monotonically_increasing_id()), "rows")
        found = jaccard.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, percent=80)
        copies = save(found.where("component_id < doc_id").select(F.col("doc_id").alias("_row")), "copies")
        return rows.join(copies, "_row", "left_anti").select(*COLUMNS)
    joined = save(jaccard.jaccard_components(docs, k=5, percent=80).where("component_id < doc_id").select("doc_id").distinct(), "copies")
    if joined.count() <= BROADCAST_IDS:
        joined = F.broadcast(joined)
    return docs.join(joined, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item in tiles of five words or more go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The draws of a mixture that repeats no source over 1.5 times and reads all at least once."""
    return mixing.mix(docs.select(*COLUMNS), max_repeats=1.5).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard (0 to 15) and slot."""
    return sharding.shard(docs.select(*COLUMNS), shards=16)


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: Sketches, hashes and tiles are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with noted() as made:
            docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
