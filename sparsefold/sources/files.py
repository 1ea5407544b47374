"""Readers and writers of count files. Texts and NumPy archives are read by tasks, each its own part; archives and .npy labels are written by the driver, as they are one file each."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import normalise_counts, numbered
from . import archives

COUNTS = archives.COUNTS


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts (cell_id, gene_id, cnt) from .parquet (long form), .npz (CSR), .npy (dense) or .mtx[.gz], cells by genes."""
    low = path.lower()
    if low.endswith(".parquet"):
        rows = spark.read.parquet(path).select("cell_id", "gene_id", "cnt")
    elif low.endswith((".npz", ".npy")):
        archives.register(spark)
        rows = spark.read.format("csr_archive" if low.endswith(".npz") else "dense_array").option("path", path).load()
    elif low.endswith((".mtx", ".mtx.gz")):
        rows = read_matrix_market(spark, path)
    elif low.endswith((".tsv", ".tsv.gz")):
        raise ValueError("convert TSV files first: python -m sparsefold.cli convert")
    else:
        raise ValueError(f"unknown count file: {path}")
    return normalise_counts(rows)


def read_shape(spark: SparkSession, path: str) -> tuple[int, int]:
    """Cells and genes of a count file, with those that have no counts: from its header, or of a table the largest numbers."""
    low = path.lower()
    if low.endswith(".npz"):
        n_cells = archives.member_shape(path, "indptr")[0] - 1
        with np.load(path) as z:
            return (int(z["shape"][0]), int(z["shape"][1])) if "shape" in z.files else (n_cells, _above(read_counts(spark, path), "gene_id"))
    if low.endswith(".npy"):
        return tuple(map(int, np.load(path, mmap_mode="r").shape))
    if low.endswith((".mtx", ".mtx.gz")):
        size = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != "")).limit(1).first()[0].split()
        return int(size[0]), int(size[1])
    counts = read_counts(spark, path)
    return _above(counts, "cell_id"), _above(counts, "gene_id")


def _above(counts: DataFrame, column: str) -> int:
    most = counts.agg(F.max(column)).first()[0]
    return 0 if most is None else most + 1


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate entries, counted from 0; of a symmetric matrix both halves. The size line is the only one before the entries that is no comment, so it is told apart by the header."""
    header = spark.read.text(path).where(F.col("value").startswith("%%MatrixMarket")).limit(1).first()
    lines = spark.read.text(path).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = lines.limit(1).first()[0]
    entries = lines.withColumn("p", F.split(F.trim("value"), r"\s+"))
    # an entry may look like the size line; one of the equal lines is the size
    same = entries.where(F.col("value") == size).count() - 1
    rows = entries.where(F.col("value") != size)
    got = rows.select((F.col("p")[0].cast("long") - 1).alias("cell_id"), (F.col("p")[1].cast("int") - 1).alias("gene_id"), F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)).alias("cnt"))
    if same > 0:
        s = size.split()
        got = got.unionByName(spark.createDataFrame([(int(s[0]) - 1, int(s[1]) - 1, float(s[2]))] * same, COUNTS))
    if header and header[0].lower().split()[-1:] == ["symmetric"]:
        got = got.unionByName(got.where("cell_id <> gene_id").select(F.col("gene_id").cast("long").alias("cell_id"), F.col("cell_id").cast("int").alias("gene_id"), "cnt"))
    return got


def read_wide_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A header with cell names and a row per gene -> counts; empty is 0, fractions are cut off, genes without counts are dropped and the others numbered in order.

    Cells are numbered by column. Names are returned by :func:`tsv_names`.
    """
    wide = spark.read.csv(path, sep="\t", header=True)
    gene, cells = wide.columns[0], wide.columns[1:]
    numbered = wide.select(F.monotonically_increasing_id().alias("_g"), *[F.col(f"`{c}`") for c in cells]).withColumnsRenamed({c: str(i) for i, c in enumerate(cells)})
    tall = numbered.unpivot("_g", [F.col(f"`{i}`") for i in range(len(cells))], "cell", "v")
    counts = tall.select("_g", F.col("cell").cast("long").alias("cell_id"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).cast("long").alias("cnt")).where("cnt <> 0")
    return normalise_counts(counts.join(_gene_ids(counts), "_g").select("cell_id", "gene_id", "cnt"))


def _gene_ids(counts: DataFrame) -> DataFrame:
    return numbered(counts, "_g", "gene_id").withColumn("gene_id", F.col("gene_id").cast("int"))


def tsv_names(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Cell names of the header, and (gene_id, gene): the first column of the genes that have counts, by their numbers."""
    wide = spark.read.csv(path, sep="\t", header=True)
    cells = wide.columns[1:]
    held = F.lit(False)
    for i in range(len(cells)):
        held |= F.coalesce(F.col(f"c{i}").cast("double"), F.lit(0.0)).cast("long") != 0
    rows = wide.toDF("gene", *[f"c{i}" for i in range(len(cells))]).withColumn("_g", F.monotonically_increasing_id()).where(held).select("_g", "gene")
    return cells, rows.join(_gene_ids(rows), "_g").select("gene_id", "gene")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, cluster_id) from a one-dimensional .npy or a text file with a whole number per line, in order."""
    if path.endswith(".npy"):
        labels = np.load(path)
        if labels.ndim != 1:
            raise ValueError("labels have one dimension")
    else:
        with open(path, encoding="utf-8") as f:
            labels = np.array([int(x) for x in f.read().split()], np.int64)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(len(labels), dtype=np.int64), "cluster_id": labels.astype(np.int64)}), "cell_id long, cluster_id long")


def find_files(spark: SparkSession, root: str, pattern: str = "RNAmatrix*.tsv") -> list[str]:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    return sorted(r[0] for r in rows.collect())


def write_counts(counts: DataFrame, path: str, overwrite: bool = True) -> None:
    counts.write.mode("overwrite" if overwrite else "ignore").parquet(path)


def write_npz(counts: DataFrame, path: str, n_cells: int, n_genes: int) -> None:
    """One CSR archive, for other programs; it must fit the driver."""
    got = counts.orderBy("cell_id", "gene_id").toPandas()
    indptr = np.concatenate(([0], np.cumsum(np.bincount(got.cell_id, minlength=n_cells))))
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    np.savez_compressed(path, data=got.cnt.to_numpy(), indices=got.gene_id.to_numpy(np.int32), indptr=indptr, shape=np.array([n_cells, n_genes]), format=np.array(b"csr"))


def write_labels(assign: DataFrame, path: str) -> None:
    """.npy of 32-bit labels in the order of cells (small results), or Parquet."""
    if path.endswith(".npy"):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        np.save(path, assign.orderBy("cell_id").toPandas().cluster_id.to_numpy(np.int32))
    else:
        assign.write.mode("overwrite").parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_summary(summary: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(summary, f, indent=2)
