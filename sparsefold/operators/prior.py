"""Priors: one positive pseudocount per gene."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import power_of_two
from ..sources.shared import saved
from .likelihood import partition_ll
from .model import Partition


def global_frequency(counts: DataFrame, genes: DataFrame, least: float = 1e-12) -> DataFrame:
    """Share of each gene in all counts (uniform if there are none), at least ``least`` / genes, normalised again."""
    own = genes.select("gene_id").join(counts.groupBy("gene_id").agg(F.sum("cnt").alias("t")), "gene_id", "left").fillna(0, ["t"])
    sums = own.agg(F.sum("t").alias("all"), F.count(F.lit(1)).alias("n"))
    p = F.when(F.col("all") > 0, F.col("t") / F.col("all")).otherwise(1.0 / F.col("n"))
    floored = own.join(F.broadcast(sums), F.lit(True)).select("gene_id", F.greatest(p, F.lit(least) / F.col("n")).alias("p"))
    return floored.join(F.broadcast(floored.agg(F.sum("p").alias("s"))), F.lit(True)).select("gene_id", (F.col("p") / F.col("s")).alias("p"))


def make_prior(counts: DataFrame, genes: DataFrame, tau: float, mode: str = "global_frequency", least: float = 1e-12) -> DataFrame:
    if tau <= 0:
        raise ValueError("tau must be positive")
    if mode != "global_frequency":
        raise ValueError(f"unknown prior mode: {mode}")
    return global_frequency(counts, genes, least).select("gene_id", (F.lit(float(tau)) * F.col("p")).alias("psi"))


def audit_prior(counts: DataFrame, genes: DataFrame, tau: float = 1.0, mode: str = "global_frequency") -> DataFrame:
    """The audit's prior: gene sums plus 1e-12, normalised; or ``uniform``."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    if mode not in ("global_frequency", "uniform"):
        raise ValueError(f"unknown prior mode: {mode}")
    own = genes.select("gene_id").join(counts.groupBy("gene_id").agg(F.sum("cnt").alias("t")), "gene_id", "left").fillna(0, ["t"])
    weight = F.lit(1.0) if mode == "uniform" else F.col("t") + 1e-12
    own = own.select("gene_id", weight.alias("w"))
    return own.join(F.broadcast(own.agg(F.sum("w").alias("s"))), F.lit(True)).select("gene_id", (F.lit(float(tau)) * F.col("w") / F.col("s")).alias("psi"))


def invalid_prior(prior: DataFrame) -> DataFrame:
    return prior.where(F.col("psi").isNull() | F.isnan("psi") | (F.col("psi") <= 0) | (F.col("psi") == float("inf")))


def auto_tau(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: the power of two nearest (in logarithm) to the mean total of a cell."""
    umis = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n_umis"))
    n = cells.agg(F.count(F.lit(1)).alias("n_cells"))
    both = umis.join(n, F.lit(True))
    return both.select("n_umis", "n_cells", F.when((F.col("n_umis") <= 0) | (F.col("n_cells") <= 0), 1.0).otherwise(power_of_two(F.col("n_umis") / F.col("n_cells"))).alias("tau"))


def optimise_tau(state: Partition, prior: DataFrame, tau: float, factor: float = 1000.0, steps: int = 9, width: int = 17) -> tuple[float, float]:
    """Maximise the likelihood over log tau within a factor of ``tau``: a grid per job, narrowed around its best by 8 each time, to 1e-7 of log tau."""
    invalid = invalid_prior(prior).limit(1).count()
    if invalid:
        raise ValueError("the prior must be positive and finite")
    cluster_gene, stat = saved(state.cluster_gene), saved(state.cluster_stat)
    lo, hi = math.log(tau / factor), math.log(tau * factor)
    best = (tau, -math.inf)
    for _ in range(steps):
        grid = [lo + (hi - lo) * i / (width - 1) for i in range(width)]
        rows = partition_ll(cluster_gene, stat, prior, tau, [math.exp(g) / tau for g in grid]).collect()
        rows.sort(key=lambda r: r["scale"])
        i = max(range(width), key=lambda j: rows[j]["ll"])
        best = max(best, (math.exp(grid[i]), rows[i]["ll"]), key=lambda x: x[1])
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, width - 1)]
    return best
