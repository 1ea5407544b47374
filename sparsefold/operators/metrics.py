"""Agreement of two labellings, from their contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label_a, label_b, n) of labels (cell_id, cluster_id)."""
    return a.select("cell_id", F.col("cluster_id").alias("label_a")).join(b.select("cell_id", F.col("cluster_id").alias("label_b")), "cell_id").groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def agreement(table: DataFrame) -> DataFrame:
    """One row: n, Rand index, adjusted Rand index, Fowlkes-Mallows score."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    both = table.agg(pairs("n").alias("t"), F.sum("n").alias("n"))
    rows = table.groupBy("label_a").agg(F.sum("n").alias("m")).agg(pairs("m").alias("p"))
    cols = table.groupBy("label_b").agg(F.sum("n").alias("m")).agg(pairs("m").alias("q"))
    one = both.join(rows, F.lit(True)).join(cols, F.lit(True))
    t, p, q, n = (F.col(c) for c in "tpqn")
    every = n * (n - 1) / 2
    expected, most = p * q / F.nullif(every, F.lit(0.0)), (p + q) / 2
    rand = F.when(n < 2, 1.0).otherwise((every + 2 * t - p - q) / F.nullif(every, F.lit(0.0)))
    ari = F.when((n < 2) | (most == expected), 1.0).otherwise((t - expected) / F.nullif(most - expected, F.lit(0.0)))
    fms = F.when((p == 0) | (q == 0), 0.0).otherwise(t / F.sqrt(p * q))
    return one.select("n", rand.alias("rand_index"), ari.alias("ari"), fms.alias("fms"))


def majority(assign: DataFrame, reference: DataFrame, least_purity: float = 0.6) -> DataFrame:
    """Per cluster its most frequent reference label, kept where its share reaches ``least_purity``."""
    from pyspark.sql import Window

    table = contingency(assign, reference)
    w = Window.partitionBy("label_a")
    got = table.withColumn("size", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "label_b"))).where("r = 1")
    return got.withColumn("purity", F.col("n") / F.col("size")).where(F.col("purity") >= least_purity).select(F.col("label_a").alias("cluster_id"), F.col("label_b").alias("reference"), "purity")


def aligned_labels(target: DataFrame, source: DataFrame) -> DataFrame:
    """target (position, cell_id), source (cell_id, label) -> labels in the order of target; sets of cells must be equal and unique."""
    n, m = target.count(), source.count()
    if n != m or target.select("cell_id").distinct().count() != n or source.select("cell_id").distinct().count() != m:
        raise ValueError("cell ids must be unique and as many on both sides")
    if target.join(source, "cell_id", "left_anti").limit(1).count():
        raise ValueError("a cell of the target has no label")
    return target.join(source, "cell_id").select("position", "cell_id", "label")


def timing_totals(history: DataFrame) -> DataFrame:
    """history (round, timing_s MAP of phase to seconds) -> (phase, seconds) over all rounds."""
    return history.select(F.explode("timing_s").alias("phase", "s")).groupBy("phase").agg(F.sum("s").alias("seconds"))


def run_means(runs: DataFrame) -> DataFrame:
    """runs (method, status, elapsed_s, ari_vs_truth, n_clusters, log_likelihood) -> completed runs of each method and their means; null where none was completed."""
    done = F.col("status") == "completed"
    means = [F.avg(F.when(done, F.col(c))).alias(f"mean_{c}") for c in ("elapsed_s", "ari_vs_truth", "n_clusters", "log_likelihood")]
    return runs.groupBy("method").agg(F.count_if(done).alias("n_runs"), *means)
