"""Collapsed Dirichlet-multinomial likelihoods and the change that each kind of move makes.

With f(c) = ln Gamma(c + psi) - ln Gamma(psi), terms of genes that a pair does not share cancel, so every score
is a join on shared genes, a partial aggregate, and a join of totals. ``psi0`` is the sum of the prior.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import gain, lgamma


def psi0_of(prior: DataFrame) -> float:
    return float(prior.agg(F.sum("psi")).first()[0])


#: Rows of a table per cluster that may be broadcast.
BROADCAST_CLUSTERS = 500_000


def few(df: DataFrame) -> DataFrame:
    """``df``, with a hint to broadcast it if it is small enough."""
    return F.broadcast(df) if df.limit(BROADCAST_CLUSTERS + 1).count() <= BROADCAST_CLUSTERS else df


#: Rows of a table, those most often met, that a join by gene broadcasts; the others are met by a shuffle.
BROADCAST_GENES = 300_000


def met_by_size(rows: DataFrame, table: DataFrame, keys: list[str], size: str, most: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (unique by ``keys``, ``size`` > 0; read three times): the rows of largest ``size``, at most ``most``, are broadcast.

    Few genes make most of the counts, so most rows stay where they are and only those of rare genes are shuffled.
    """
    most = BROADCAST_GENES if most is None else most
    level = F.floor(F.log2(size) * 4)
    levels = sorted(table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    held, cut = 0, None
    for at, n in levels:
        held += n
        if held > most:
            break
        cut = at
    if not levels or cut == levels[-1][0]:
        return rows.join(F.broadcast(table) if levels else table, keys)
    if cut is None:
        return rows.join(table, keys)
    large = F.broadcast(table.where(level >= cut))
    rest = rows.join(F.broadcast(table.where(level >= cut).select(*keys)), keys, "left_anti").join(table.where(level < cut), keys)
    return rows.join(large, keys).unionByName(rest)


def _head(total, psi0: float):
    """ln Gamma(psi0) - ln Gamma(total + psi0), exactly 0 for a total of 0."""
    z = f"{float(psi0)!r}D"
    return F.when(F.col(total) == 0, 0.0).otherwise(lgamma(z) - lgamma(f"{total} + {z}"))


def grouped_ll(rows: DataFrame, keys: DataFrame, key: str, prior: DataFrame, psi0: float, many: bool = False) -> DataFrame:
    """Likelihood of each summed count vector; ``keys`` (key, total) keeps those without counts, whose likelihood is 0. ``many``: the rows are to stay where they are, as far as they can."""
    met = met_by_size(rows, prior, ["gene_id"], "psi") if many else rows.join(prior, "gene_id")
    body = met.groupBy(key).agg(F.sum(gain("cnt", "psi")).alias("body"))
    return keys.join(body, key, "left").withColumn("ll", _head("total", psi0) + F.coalesce("body", F.lit(0.0))).drop("body")


def cluster_ll(cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    return grouped_ll(cluster_gene, cluster_stat, "cluster_id", prior, psi0)


def cell_ll(counts: DataFrame, totals: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    """Each cell as a cluster of its own."""
    return grouped_ll(counts, totals.select("cell_id", "total"), "cell_id", prior, psi0, many=True)


def partition_ll(cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float, scales: list[float] = (1.0,)) -> DataFrame:
    """(scale, ll): the whole likelihood with the prior times each scale, in one pass over the counts."""
    grid = F.explode(F.array(*[F.lit(float(s)) for s in scales])).alias("scale")
    scale = F.col("scale")
    body = cluster_gene.join(prior, "gene_id").select("cnt", "psi", grid).groupBy("scale").agg(F.sum(gain(F.col("cnt"), F.col("psi") * scale)).alias("body"))
    z = F.lit(float(psi0)) * scale
    head = F.when(F.col("total") == 0, 0.0).otherwise(lgamma(z) - lgamma(F.col("total") + z))
    head = cluster_stat.select("total", grid).groupBy("scale").agg(F.sum(head).alias("head"))
    every = cluster_stat.sparkSession.range(1).select(grid)
    got = every.join(body, "scale", "left").join(head, "scale", "left")
    return got.select("scale", (F.coalesce("body", F.lit(0.0)) + F.coalesce("head", F.lit(0.0))).alias("ll"))


def merge_deltas(cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float, pairs: DataFrame | None = None) -> DataFrame:
    """(cluster_a, cluster_b, delta) for ``pairs``, or for all a < b."""
    t = cluster_stat.select("cluster_id", "total")
    a, b = (t.select(F.col("cluster_id").alias(f"cluster_{x}"), F.col("total").alias(f"n_{x}")) for x in "ab")
    if pairs is None:
        keys = a.join(b, F.col("cluster_a") < F.col("cluster_b"))
    else:
        keys = pairs.select("cluster_a", "cluster_b").where("cluster_a <> cluster_b").join(a, "cluster_a").join(b, "cluster_b")
    g = cluster_gene.select("gene_id", F.col("cluster_id").alias("cluster_a"), F.col("cnt").alias("c_a"))
    h = cluster_gene.select("gene_id", F.col("cluster_id").alias("cluster_b"), F.col("cnt").alias("c_b"))
    if pairs is None:
        met = g.join(h, (g["gene_id"] == h["gene_id"]) & (F.col("cluster_a") < F.col("cluster_b"))).drop(h["gene_id"])
    else:
        met = keys.select("cluster_a", "cluster_b").join(g, "cluster_a").join(h, ["gene_id", "cluster_b"])
    term = gain("c_a + c_b", "psi") - gain("c_a", "psi") - gain("c_b", "psi")
    body = met.join(prior, "gene_id").groupBy("cluster_a", "cluster_b").agg(F.sum(term).alias("body"))
    z = f"{float(psi0)!r}D"
    head = lgamma(f"n_a + {z}") + lgamma(f"n_b + {z}") - lgamma(z) - lgamma(f"n_a + n_b + {z}")
    return keys.join(body, ["cluster_a", "cluster_b"], "left").select("cluster_a", "cluster_b", (head + F.coalesce("body", F.lit(0.0))).alias("delta"))


def remove_deltas(blocks: DataFrame, sources: DataFrame, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    """blocks (block_id, gene_id, cnt), sources (block_id, source, n) -> (block_id, source, n, removed, own): the change in the source, and the block's own likelihood.

    A block that holds more of a gene than its source raises.
    """
    at = cluster_gene.select(F.col("cluster_id").alias("source"), "gene_id", F.col("cnt").alias("c"))
    met = blocks.join(sources.select("block_id", "source"), "block_id").join(at, ["source", "gene_id"], "left").join(prior, "gene_id")
    c, x = F.coalesce("c", F.lit(0)), F.col("cnt")
    left = F.when(c < x, F.raise_error(F.lit("a block holds more than its source"))).otherwise(c - x)
    met = met.withColumns({"_c": c, "_left": left})
    body = met.groupBy("block_id").agg(F.sum(gain("_left", "psi") - gain("_c", "psi")).alias("body"), F.sum(gain("cnt", "psi")).alias("own_body"))
    n_s = cluster_stat.select(F.col("cluster_id").alias("source"), F.col("total").alias("n_source"))
    z = f"{float(psi0)!r}D"
    out = sources.join(n_s, "source").join(body, "block_id", "left")
    removed = lgamma(f"n_source + {z}") - lgamma(f"n_source - n + {z}") + F.coalesce("body", F.lit(0.0))
    return out.select("block_id", "source", "n", removed.alias("removed"), (_head("n", psi0) + F.coalesce("own_body", F.lit(0.0))).alias("own"))


def add_deltas(blocks: DataFrame, pairs: DataFrame, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    """pairs (block_id, target, n) -> (block_id, target, added): the change in each target."""
    at = cluster_gene.select(F.col("cluster_id").alias("target"), "gene_id", F.col("cnt").alias("c"))
    own = blocks.join(prior, "gene_id").groupBy("block_id").agg(F.sum(gain("cnt", "psi")).alias("own_body"))
    shared = blocks.join(at, "gene_id").join(pairs.select("block_id", "target"), ["block_id", "target"], "left_semi").join(prior, "gene_id")
    shared = shared.groupBy("block_id", "target").agg(F.sum(gain("c + cnt", "psi") - gain("c", "psi") - gain("cnt", "psi")).alias("body"))
    n_t = cluster_stat.select(F.col("cluster_id").alias("target"), F.col("total").alias("n_target"))
    z = f"{float(psi0)!r}D"
    out = pairs.join(n_t, "target").join(own, "block_id", "left").join(shared, ["block_id", "target"], "left")
    added = lgamma(f"n_target + {z}") - lgamma(f"n_target + n + {z}") + F.coalesce("own_body", F.lit(0.0)) + F.coalesce("body", F.lit(0.0))
    return out.select("block_id", "target", added.alias("added"))


def peel_deltas(blocks: DataFrame, sources: DataFrame, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    """(block_id, source, delta) of making each block (or single cell) a cluster."""
    got = remove_deltas(blocks, sources, cluster_gene, cluster_stat, prior, psi0)
    return got.select("block_id", "source", (F.col("removed") + F.col("own")).alias("delta"))


def move_deltas(blocks: DataFrame, sources: DataFrame, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float, targets: DataFrame | None = None) -> DataFrame:
    """(block_id, source, target, delta) for ``targets`` (block_id, target), or for every other cluster."""
    removed = remove_deltas(blocks, sources, cluster_gene, cluster_stat, prior, psi0)
    if targets is None:
        pairs = sources.join(few(cluster_stat.select(F.col("cluster_id").alias("target"))), F.col("source") != F.col("target"))
    else:
        pairs = targets.join(sources, "block_id").where("source <> target")
    added = add_deltas(blocks, pairs.select("block_id", "target", "n"), cluster_gene, cluster_stat, prior, psi0)
    return removed.join(added, "block_id").select("block_id", "source", "target", (F.col("removed") + F.col("added")).alias("delta"))


def cells_as_blocks(counts: DataFrame, totals: DataFrame, assign: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Single cells in the form that the scorers of blocks take."""
    blocks = counts.select(F.col("cell_id").alias("block_id"), "gene_id", "cnt")
    sources = assign.join(totals.select("cell_id", "total"), "cell_id").select(F.col("cell_id").alias("block_id"), F.col("cluster_id").alias("source"), F.col("total").alias("n"))
    return blocks, sources
