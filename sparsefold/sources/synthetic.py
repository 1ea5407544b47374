"""Synthetic counts: clusters with blocks of marker genes, drawn in tasks, each cell from its own stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Synthetic:
    """counts (cell_id, gene_id, cnt), labels (cell_id, cluster_id), profiles (cluster_id, gene_id, p)."""

    counts: DataFrame
    labels: DataFrame
    profiles: DataFrame


def _profile(cluster: int, n_clusters: int, n_genes: int, marker: float, background: float, seed: int) -> np.ndarray:
    """A Dirichlet draw, by Gamma draws, in which the genes of the cluster's block weigh more."""
    span = max(1, n_genes // n_clusters)
    first = cluster * span % n_genes
    shape = np.full(n_genes, background)
    shape[first : first + span] += marker
    drawn = np.random.default_rng([seed, 0, cluster]).standard_gamma(shape)
    return drawn / drawn.sum()


def generate(spark: SparkSession, n_clusters: int = 3, cells_per_cluster: int = 12, n_genes: int = 30, umi_low: int = 40, umi_high: int = 80, marker: float = 25.0, background: float = 1.0, seed: int = 0) -> Synthetic:
    """Cells with totals uniform in ``umi_low`` .. ``umi_high``, split over the genes by their cluster's profile.

    A cell's counts are a multinomial draw, gene by gene a binomial one of what is left, from a stream keyed by seed and
    cell, so they do not depend on partitions.
    """

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, np.ndarray] | None = None
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                cluster = cell // cells_per_cluster
                if known is None or known[0] != cluster:
                    known = cluster, _profile(cluster, n_clusters, n_genes, marker, background, seed)
                rng = np.random.default_rng([seed, 1, cell])
                counts = rng.multinomial(rng.integers(umi_low, umi_high, endpoint=True), known[1])
                genes = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(genes), cell)), pa.array(genes.astype(np.int32)), pa.array(counts[genes].astype(np.int64))], names=["cell_id", "gene_id", "cnt"])

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cluster in batch.column(0).to_pylist():
                p = _profile(cluster, n_clusters, n_genes, marker, background, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n_genes, cluster)), pa.array(np.arange(n_genes, dtype=np.int32)), pa.array(p)], names=["cluster_id", "gene_id", "p"])

    cells = spark.range(n_clusters * cells_per_cluster)
    labels = cells.select(F.col("id").alias("cell_id"), F.expr(f"id div {cells_per_cluster}").alias("cluster_id"))
    return Synthetic(cells.mapInArrow(drawn, "cell_id long, gene_id int, cnt long"), labels, spark.range(n_clusters).mapInArrow(profiled, "cluster_id long, gene_id int, p double"))
