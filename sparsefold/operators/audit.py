"""Audit of a partition: which clusters look like mixtures of two others.

All clusters are audited in one plan. A candidate parent's profile over a target's genes is held as an array per
(target, parent), so the integral over the mixture weight runs inside one row per pair instead of one row per
pair, gene and weight.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import TINY, lgamma, nb_logpmf
from ..sources.shared import saved
from .likelihood import few, psi0_of
from .model import Partition


#: Candidate parents of a cluster.
TOP_M = 50


@dataclass(frozen=True)
class Thresholds:
    total: float = 10.0
    possible_expr: float = 0.0
    parent_gain: float = 5.0
    parent_gain_per_umi: float = 1e-4
    edge: float = 0.05
    min_cells: int = 3
    min_umis: float = 10


def self_loo(state: Partition, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    """(cluster_id, l_self): predictive likelihood of each cell given the rest of its cluster, summed."""
    met = state.counts.join(state.assign, "cell_id").join(cluster_gene.withColumnRenamed("cnt", "c"), ["cluster_id", "gene_id"]).join(prior, "gene_id")
    x, rest, psi = F.col("cnt"), F.col("c") - F.col("cnt"), F.col("psi")
    cells = met.groupBy("cluster_id", "cell_id").agg(F.sum(x).alias("n"), F.sum(lgamma(rest + x + psi) - lgamma(rest + psi)).alias("body"))
    z, left = F.lit(psi0), F.col("total") - F.col("n")
    per = cells.join(cluster_stat.select("cluster_id", "total"), "cluster_id").groupBy("cluster_id").agg(F.sum(lgamma(left + z) - lgamma(left + F.col("n") + z) + F.col("body")).alias("l_self"))
    return cluster_stat.select("cluster_id").join(per, "cluster_id", "left").fillna(0.0, ["l_self"])


def parent_scores(cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    """(target, parent, score): log-likelihood of a target's counts under every other cluster's profile."""
    t = cluster_gene.select(F.col("cluster_id").alias("target"), "gene_id", F.col("cnt").alias("x")).join(prior, "gene_id")
    base = cluster_stat.select(F.col("cluster_id").alias("target"), F.col("total").alias("n_t")).join(t.groupBy("target").agg(F.sum(F.col("x") * F.log("psi")).alias("base")), "target", "left")
    p = cluster_gene.select(F.col("cluster_id").alias("parent"), "gene_id", F.col("cnt").alias("c"))
    shared = t.join(p, "gene_id").where("target <> parent").groupBy("target", "parent").agg(F.sum(F.col("x") * (F.log(F.col("c") + F.col("psi")) - F.log("psi"))).alias("extra"))
    pairs = base.join(few(cluster_stat.select(F.col("cluster_id").alias("parent"), F.col("total").alias("n_p"))), F.col("target") != F.col("parent"))
    score = F.coalesce("base", F.lit(0.0)) - F.col("n_t") * F.log(F.col("n_p") + F.lit(psi0)) + F.coalesce("extra", F.lit(0.0))
    return pairs.join(shared, ["target", "parent"], "left").select("target", "parent", score.alias("score"))


def candidates(scores: DataFrame, top_m: int = TOP_M, provided: DataFrame | None = None) -> DataFrame:
    """(target, parent): the ``top_m`` best parents, or those ``provided``."""
    if provided is not None:
        return scores.join(provided, ["target", "parent"] if "target" in provided.columns else ["parent"], "left_semi").select("target", "parent")
    w = Window.partitionBy("target").orderBy(F.desc("score"), "parent")
    return scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top_m).select("target", "parent")


def parent_pairs(chosen: DataFrame, homotypic: bool = False) -> DataFrame:
    a, b = chosen.select("target", F.col("parent").alias("a")), chosen.select(F.col("target").alias("t2"), F.col("parent").alias("b"))
    return a.join(b, (F.col("target") == F.col("t2")) & ((F.col("a") <= F.col("b")) if homotypic else (F.col("a") < F.col("b")))).drop("t2")


def pair_priors(pairs: DataFrame, cluster_stat: DataFrame, mode: str | None = "collision_normalized") -> DataFrame:
    """pairs with n_a, n_b, n_total, collision and pair_prior = ln(w / sum of w over the target's pairs)."""
    if mode not in ("collision_normalized", "none", None):
        raise ValueError("pair prior mode must be collision_normalized or none")
    s = cluster_stat.select("cluster_id", "n_cells")
    out = pairs.join(few(s.select(F.col("cluster_id").alias("a"), F.col("n_cells").alias("n_a"))), "a").join(few(s.select(F.col("cluster_id").alias("b"), F.col("n_cells").alias("n_b"))), "b")
    out = out.join(F.broadcast(s.agg(F.sum("n_cells").alias("n_total"))), F.lit(True))
    total = F.greatest(F.col("n_total").cast("double"), F.lit(1.0))
    fa, fb = F.col("n_a") / total, F.col("n_b") / total
    out = out.withColumn("collision", F.when(F.col("a") == F.col("b"), fa * fa).otherwise(2 * fa * fb))
    w = F.greatest("collision", F.lit(TINY))
    prior = F.lit(0.0) if mode in ("none", None) else F.log(w) - F.log(F.sum(w).over(Window.partitionBy("target")))
    return out.withColumn("pair_prior", prior)


def size_priors(cluster_stat: DataFrame, least_phi: float = 0.5, most_phi: float = 100.0) -> DataFrame:
    """(target, mean, phi): negative binomial fitted to the sizes of the other clusters, singletons left out (all clusters if none is left)."""
    s = cluster_stat.select(F.col("cluster_id").alias("target"), F.col("n_cells").cast("double").alias("n"))
    sums = s.agg(F.count(F.when(F.col("n") > 1, 1)).alias("m1"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0.0)).alias("s1"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") * F.col("n"))), F.lit(0.0)).alias("q1"), F.count(F.when(F.col("n") > 0, 1)).alias("m0"), F.sum("n").alias("s0"), F.sum(F.col("n") * F.col("n")).alias("q0"))
    own = F.when(F.col("n") > 1, 1).otherwise(0)
    j = s.join(F.broadcast(sums), F.lit(True)).withColumn("k", F.col("m1") - own)
    none = F.col("k") == 0
    m = F.when(none, F.col("m0")).otherwise(F.col("k"))
    total = F.when(none, F.col("s0")).otherwise(F.col("s1") - own * F.col("n"))
    square = F.when(none, F.col("q0")).otherwise(F.col("q1") - own * F.col("n") * F.col("n"))
    mean = total / m
    var = F.when(m > 1, (square - m * mean * mean) / (m - 1)).otherwise(mean + mean * mean / least_phi)
    phi = F.when(var <= mean, F.lit(most_phi)).otherwise(mean * mean / (var - mean))
    return j.select("target", F.greatest(mean, F.lit(1e-6)).alias("mean"), F.least(F.greatest(phi, F.lit(least_phi)), F.lit(most_phi)).alias("phi"))


def abundance(pairs: DataFrame, cluster_stat: DataFrame, rate: float = 0.05, phi: float = 2.0) -> DataFrame:
    """pairs (from :func:`pair_priors`) with abundance = NB(size; expected doublets) - NB(size; simplet sizes)."""
    size = cluster_stat.select(F.col("cluster_id").alias("target"), F.col("n_cells").alias("n_target"))
    out = pairs.join(few(size), "target").join(few(size_priors(cluster_stat)), "target")
    expected = F.col("n_total") * F.lit(rate) * F.col("collision")
    return out.withColumn("abundance", nb_logpmf(F.col("n_target"), expected, F.lit(phi)) - nb_logpmf(F.col("n_target"), F.col("mean"), F.col("phi"))).drop("mean", "phi")


def _profiles(chosen: DataFrame, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float) -> DataFrame:
    """(target, parent, q): the parent's probabilities of the target's genes, in the order of gene_id."""
    t = cluster_gene.select(F.col("cluster_id").alias("target"), "gene_id", F.col("cnt").alias("x"))
    p = cluster_gene.select(F.col("cluster_id").alias("parent"), "gene_id", F.col("cnt").alias("c"))
    met = chosen.join(t, "target").join(p, ["parent", "gene_id"], "left").join(prior, "gene_id").join(few(cluster_stat.select(F.col("cluster_id").alias("parent"), "total")), "parent")
    q = (F.coalesce("c", F.lit(0)) + F.col("psi")) / (F.col("total") + F.lit(psi0))
    return met.groupBy("target", "parent").agg(F.array_sort(F.collect_list(F.struct("gene_id", F.col("x").cast("double").alias("x"), q.alias("q")))).alias("items"))


def mixtures(pairs: DataFrame, chosen: DataFrame, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float, grid_size: int = 101, beta: tuple[float, float] = (2.0, 2.0)) -> DataFrame:
    """pairs with l_mix, lambda_map, lambda_mean and posterior: the target's likelihood integrated over the mixture weight."""
    if grid_size < 3:
        raise ValueError("the grid needs three points or more")
    al, be = beta
    flat = al == 1.0 and be == 1.0
    norm = math.lgamma(al) + math.lgamma(be) - math.lgamma(al + be)
    grid = [i / (grid_size - 1) for i in range(grid_size)]
    log_prior = [0.0 if flat and l in (0.0, 1.0) else -math.inf if l in (0.0, 1.0) else (al - 1) * math.log(l) + (be - 1) * math.log1p(-l) - norm for l in grid]
    held = _profiles(chosen, cluster_gene, cluster_stat, prior, psi0)
    pa, pb = held.select("target", F.col("parent").alias("a"), F.col("items").alias("ia")), held.select("target", F.col("parent").alias("b"), F.col("items.q").alias("qb"))
    rows = pairs.join(pa, ["target", "a"], "left").join(pb, ["target", "b"], "left")
    # a target without counts has no items: every weight is as likely
    items = F.zip_with(F.col("ia"), F.col("qb"), lambda i, q: F.struct(i["x"].alias("x"), i["q"].alias("a"), q.alias("b")))
    rows = rows.withColumn("items", items).drop("ia", "qb")
    points = F.array(*[F.struct(F.lit(l).alias("l"), F.lit(lp).alias("p")) for l, lp in zip(grid, log_prior)])
    lik = lambda g: F.aggregate(F.coalesce("items", F.array().cast("array<struct<x:double,a:double,b:double>>")), F.lit(0.0), lambda s, i: s + i["x"] * F.log(F.greatest(g["l"] * i["a"] + (1 - g["l"]) * i["b"], F.lit(TINY))))
    rows = rows.withColumn("terms", F.transform(points, lambda g: F.when(g["p"] == float("-inf"), F.lit(float("-inf"))).otherwise(lik(g) + g["p"]))).drop("items")
    rows = rows.withColumn("top", F.array_max("terms"))
    rows = rows.withColumn("mass", F.transform("terms", lambda t: F.exp(t - F.col("top")))).withColumn("sum", F.aggregate("mass", F.lit(0.0), lambda s, m: s + m))
    lams = F.array(*[F.lit(l) for l in grid])
    return rows.select(
        *pairs.columns,
        (F.col("top") + F.log("sum") - F.lit(math.log(grid_size - 1))).alias("l_mix"),
        F.element_at(lams, F.array_position("terms", F.col("top")).cast("int")).alias("lambda_map"),
        (F.aggregate(F.zip_with("mass", lams, lambda m, l: m * l), F.lit(0.0), lambda s, v: s + v) / F.col("sum")).alias("lambda_mean"),
        F.transform("mass", lambda m: m / F.col("sum")).alias("posterior"),
    )


def cell_lambdas(state: Partition, best: DataFrame, cluster_gene: DataFrame, cluster_stat: DataFrame, prior: DataFrame, psi0: float, grid_size: int = 101) -> DataFrame:
    """best (target, a, b) -> (target, cell_id, lambda): the likeliest weight of each cell, the first of equals; NaN for a cell without counts."""
    grid = [i / (grid_size - 1) for i in range(grid_size)]
    q = lambda x: cluster_gene.select(F.col("cluster_id").alias(x), "gene_id", F.col("cnt").alias(f"c{x}"))
    n = lambda x: few(cluster_stat.select(F.col("cluster_id").alias(x), F.col("total").alias(f"n{x}")))
    met = state.counts.join(state.assign.withColumnRenamed("cluster_id", "target"), "cell_id").join(best.select("target", "a", "b"), "target").join(prior, "gene_id")
    met = met.join(q("a"), ["a", "gene_id"], "left").join(q("b"), ["b", "gene_id"], "left").join(n("a"), "a").join(n("b"), "b")
    p = lambda x: (F.coalesce(f"c{x}", F.lit(0)) + F.col("psi")) / (F.col(f"n{x}") + F.lit(psi0))
    items = met.groupBy("target", "cell_id").agg(F.collect_list(F.struct(F.col("cnt").cast("double").alias("x"), p("a").alias("a"), p("b").alias("b"))).alias("items"))
    terms = F.transform(F.array(*[F.lit(l) for l in grid]), lambda l: F.aggregate("items", F.lit(0.0), lambda s, i: s + i["x"] * F.log(F.greatest(l * i["a"] + (1 - l) * i["b"], F.lit(TINY)))))
    items = items.withColumn("terms", terms)
    found = items.select("target", "cell_id", ((F.array_position("terms", F.array_max("terms")) - 1) / (grid_size - 1)).alias("lambda"))
    every = state.assign.select("cell_id", F.col("cluster_id").alias("target")).join(best.select("target"), "target", "left_semi")
    return every.join(found, ["target", "cell_id"], "left").select("target", "cell_id", F.coalesce("lambda", F.lit(float("nan"))).alias("lambda"))


def audit(state: Partition, prior: DataFrame, rate: float = 0.05, top_m: int = TOP_M, grid_size: int = 101, beta=(2.0, 2.0), abundance_weight: float = 1.0, log_prior_odds: float = 0.0, phi: float = 2.0, pair_prior_mode: str | None = "collision_normalized", provided: DataFrame | None = None, homotypic: bool = False, cell_diagnostics: bool = False, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """One row per cluster with its best pair of parents, scores and call."""
    if not 0.0 < rate < 1.0:
        raise ValueError("the doublet rate must be between 0 and 1")
    th, psi0 = thresholds, psi0_of(prior)
    # each step is a table of its own: several later steps read it, and plans stay small
    cg, stat = saved(state.cluster_gene), saved(state.cluster_stat)
    scores = saved(parent_scores(cg, stat, prior, psi0))
    chosen = saved(candidates(scores, top_m, provided))
    pairs = abundance(pair_priors(parent_pairs(chosen, homotypic), stat, pair_prior_mode), stat, rate, phi)
    pairs = mixtures(saved(pairs.select("target", "a", "b", "pair_prior", "abundance")), chosen, cg, stat, prior, psi0, grid_size, beta)
    loo = saved(self_loo(state, cg, stat, prior, psi0).withColumnRenamed("cluster_id", "target"))
    pairs = pairs.join(few(loo), "target")
    total = F.col("l_mix") - F.col("l_self") + F.lit(abundance_weight) * F.col("abundance") + F.lit(log_prior_odds) + F.col("pair_prior")
    w = Window.partitionBy("target")
    best = pairs.withColumn("total_log_odds", total).withColumn("n_pairs_tested", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("total_log_odds"), "a", "b"))).where("r = 1").drop("l_self", "posterior", "r")
    single = scores.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "parent"))).where("r = 1").select("target", F.col("parent").alias("best_single_parent"), F.col("score").alias("l_single"))
    rows = stat.select(F.col("cluster_id").alias("target"), "n_cells", F.col("total").cast("double").alias("n_umi")).join(loo, "target").join(best, "target", "left").join(single, "target", "left")
    gone, nan = F.lit(float("-inf")), F.lit(float("nan"))
    l_mix, l_single = F.coalesce("l_mix", gone), F.coalesce("l_single", gone)
    umi, expr, gain = F.greatest(F.col("n_umi"), F.lit(1.0)), l_mix - F.col("l_self"), l_mix - l_single
    n_pairs = F.coalesce("n_pairs_tested", F.lit(0))
    total = F.coalesce("total_log_odds", gone)
    out = rows.select(
        F.col("target").alias("cluster_id"), "n_cells", "n_umi", F.col("a").alias("best_parent_a"), F.col("b").alias("best_parent_b"),
        F.coalesce("lambda_map", nan).alias("lambda_map"), F.coalesce("lambda_mean", nan).alias("lambda_mean"), F.col("l_self").alias("L_self_LOO"), l_mix.alias("L_mix_best"),
        "best_single_parent", l_single.alias("L_best_single_parent"), expr.alias("expr_logBF_doublet_vs_self"), gain.alias("expr_gain_vs_best_parent"),
        (expr / umi).alias("expr_logBF_per_UMI"), (gain / umi).alias("parent_gain_per_UMI"), F.coalesce("abundance", nan).alias("abundance_logBF"), total.alias("total_log_odds"),
        (total - F.log(F.greatest(n_pairs, F.lit(1)).cast("double"))).alias("total_log_odds_minus_search_penalty"), n_pairs.alias("n_pairs_tested"),
        F.when(F.col("n_cells") <= 1, "singleton_low_confidence").when((F.col("n_cells") < th.min_cells) | (F.col("n_umi") < th.min_umis), "small_cluster_low_confidence").otherwise("ok").alias("confidence_flag"),
    )
    above = lambda c, v: (F.col(c) > v) & ~F.isnan(c)  # noqa: E731  NaN is the largest to Spark
    inside = (F.col("lambda_map") >= th.edge) & (F.col("lambda_map") <= 1.0 - th.edge) & ~F.isnan("lambda_map")
    possible = above("expr_gain_vs_best_parent", th.parent_gain) & above("expr_logBF_doublet_vs_self", th.possible_expr) & inside
    likely = possible & above("total_log_odds_minus_search_penalty", th.total) & above("parent_gain_per_UMI", th.parent_gain_per_umi) & (F.col("confidence_flag") == "ok")
    if cell_diagnostics:
        lam = cell_lambdas(state, saved(best.select("target", "a", "b")), cg, stat, prior, psi0, grid_size).where(~F.isnan("lambda")).groupBy(F.col("target").alias("cluster_id")).agg(
            F.percentile("lambda", F.lit(0.5)).alias("lambda_cell_median"), (F.percentile("lambda", F.lit(0.75)) - F.percentile("lambda", F.lit(0.25))).alias("lambda_cell_IQR"),
            F.avg(((F.col("lambda") <= th.edge) | (F.col("lambda") >= 1.0 - th.edge)).cast("double")).alias("frac_cells_lambda_extreme"))
        out = out.join(lam, "cluster_id", "left")
    return out.withColumn("call", F.when(likely, "likely_doublet").when(possible, "possible_doublet").otherwise("likely_simplet"))
