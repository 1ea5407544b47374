import json
import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsefold import cli
from sparsefold.functions.special import lgamma, nb_logpmf
from sparsefold.operators import audit as A
from sparsefold.operators import likelihood as L
from sparsefold.operators import metrics, selection
from sparsefold.operators import prior as P
from sparsefold.operators import proposals as R
from sparsefold.operators.model import Partition, cell_totals, initial, normalise_counts, numbered, urn_weights
from sparsefold.plans import sweeps
from sparsefold.plans import registry, search
from sparsefold.sources import files

M = np.array([[4, 0, 0, 0], [3, 1, 0, 0], [0, 0, 4, 0], [0, 0, 3, 1]])
Z = [0, 0, 1, 1]


def made(spark, m, z=None):
    rows = [(int(i), int(j), int(m[i, j])) for i, j in zip(*np.nonzero(m))]
    counts = spark.createDataFrame(rows, "cell_id long, gene_id int, cnt long")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(z if z is not None else range(len(m)))], "cell_id long, cluster_id long")
    return Partition(counts, labels)


def flat(spark, genes, psi):
    return spark.createDataFrame([(g, float(psi[g]) if hasattr(psi, "__len__") else float(psi)) for g in range(genes)], "gene_id int, psi double")


def dm(c, psi):
    psi = np.broadcast_to(psi, len(c))
    return math.lgamma(psi.sum()) - math.lgamma(sum(c) + psi.sum()) + sum(math.lgamma(x + p) - math.lgamma(p) for x, p in zip(c, psi))


def ll(m, z, psi):
    z = np.array(z)
    return sum(dm(m[z == k].sum(0), psi) for k in set(z.tolist()))


def test_lgamma(spark):
    xs = [1e-14, 1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 7.99, 8.0, 20.5, 1e3, 1e6, 1e9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", lgamma(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.lgamma(r.x)) <= 2e-13 * max(1, abs(math.lgamma(r.x))) for r in got)


def test_nb_logpmf(spark):
    got = spark.range(1).select(nb_logpmf(F.lit(4), F.lit(3.0), F.lit(2.0)).alias("v")).first().v
    want = math.lgamma(6) - math.lgamma(2) - math.lgamma(5) + 2 * math.log(2 / 5) + 4 * math.log(3 / 5)
    assert got == pytest.approx(want)


def test_cluster_and_partition_ll(spark):
    m = np.array([[3, 0, 0, 1], [2, 1, 0, 0], [0, 0, 4, 0], [0, 1, 3, 0], [0, 0, 0, 0]])
    s, z = made(spark, m, [0, 0, 1, 1, 2]), [0, 0, 1, 1, 2]
    pr = flat(spark, 4, 0.7)
    got = {r.cluster_id: r.ll for r in L.cluster_ll(s.cluster_gene, s.cluster_stat, pr, 2.8).collect()}
    assert got[2] == 0.0 and got[0] == pytest.approx(dm(m[:2].sum(0), 0.7))
    assert L.partition_ll(s.cluster_gene, s.cluster_stat, pr, 2.8).first().ll == pytest.approx(ll(m, z, 0.7))


def test_deltas_equal_recomputed_likelihood(spark):
    s, pr = made(spark, M, Z), flat(spark, 4, 0.5)
    model = (s.cluster_gene, s.cluster_stat, pr, 2.0)
    before = ll(M, Z, 0.5)
    assert L.merge_deltas(*model).first().delta == pytest.approx(ll(M, [0] * 4, 0.5) - before)
    blocks, sources = L.cells_as_blocks(s.counts, cell_totals(s.counts, s.assign), s.assign)
    for r in L.peel_deltas(blocks, sources, *model).collect():
        z = list(Z)
        z[r.block_id] = 9
        assert r.delta == pytest.approx(ll(M, z, 0.5) - before)
    for r in L.move_deltas(blocks, sources, *model).collect():
        z = list(Z)
        z[r.block_id] = r.target
        assert r.delta == pytest.approx(ll(M, z, 0.5) - before)
    one = spark.createDataFrame([("b", 0)], "block_id string, cell_id long")
    n = spark.createDataFrame([("b", 0, 4)], "block_id string, source long, n long")
    assert L.peel_deltas(s.block_counts(one), n, *model).first().delta == pytest.approx(ll(M, [7, 0, 1, 1], 0.5) - before)


def test_removing_too_much_raises(spark):
    s, pr = made(spark, M, Z), flat(spark, 4, 0.5)
    rows = spark.createDataFrame([("b", 0, 99)], "block_id string, gene_id int, cnt long")
    n = spark.createDataFrame([("b", 0, 99)], "block_id string, source long, n long")
    with pytest.raises(Exception, match="more than its source"):
        L.remove_deltas(rows, n, s.cluster_gene, s.cluster_stat, pr, 2.0).collect()


def test_partition_changes(spark):
    s = made(spark, M, Z)
    labels = lambda p: [r.cluster_id for r in p.assign.orderBy("cell_id").collect()]
    merged = s.merge(spark.createDataFrame([(0, 1)], "cluster_a long, cluster_b long"))
    assert labels(merged) == [0, 0, 0, 0] and merged.version == 1
    assert labels(s.move(spark.createDataFrame([(3, 0)], "cell_id long, target long"))) == [0, 0, 1, 0]
    assert labels(s.peel(spark.createDataFrame([("x", 0)], "block_id string, cell_id long"))) == [2, 0, 1, 1]
    assert labels(Partition(s.counts, s.assign.select("cell_id", (F.col("cluster_id") * 5 + 2).alias("cluster_id"))).relabelled()) == Z
    assert s.violations(s.cluster_gene, s.cluster_stat).count() == 0
    assert s.violations(s.cluster_gene.where("cnt < 7"), s.cluster_stat).count() > 0


@pytest.mark.parametrize("init", ["singletons", "one_cluster", "random", "random_online"])
def test_initial(spark, init):
    s = made(spark, M)
    got = [r.cluster_id for r in initial(s.counts, s.assign, init, 3, 1).assign.orderBy("cell_id").collect()]
    assert len(got) == 4 and (init != "singletons" or got == [0, 1, 2, 3]) and (init != "one_cluster" or set(got) == {0})
    assert init != "random_online" or set(got) == {0, 1, 2}


def test_priors(spark):
    s = made(spark, np.array([[3, 0, 1], [0, 0, 4]]))
    genes = spark.createDataFrame([(0,), (1,), (2,)], "gene_id int")
    got = {r.gene_id: r.psi for r in P.make_prior(s.counts, genes, 2.0).collect()}
    assert got[0] == pytest.approx(2 * 3 / 8) and 0 < got[1] < 1e-11 and sum(got.values()) == pytest.approx(2.0)
    assert P.auto_tau(s.counts, s.assign).first().tau == 4.0
    uniform = {r.psi for r in P.audit_prior(s.counts, genes, 3.0, "uniform").collect()}
    assert uniform == {1.0}
    with pytest.raises(ValueError):
        P.make_prior(s.counts, genes, 0)


def test_normalise_counts(spark):
    f = lambda rows: normalise_counts(spark.createDataFrame(rows, "cell_id long, gene_id int, cnt double"))
    assert [tuple(r) for r in f([(0, 0, 1.0), (0, 0, 2.0), (1, 0, 0.0)]).collect()] == [(0, 0, 3)]
    for bad in (-1.0, 1.5):
        with pytest.raises(Exception):
            f([(0, 0, bad)]).collect()


def test_agreement(spark):
    a = spark.createDataFrame([(i, x) for i, x in enumerate([0, 0, 1, 1, 2])], "cell_id long, cluster_id long")
    b = spark.createDataFrame([(i, x) for i, x in enumerate([5, 5, 6, 7, 7])], "cell_id long, cluster_id long")
    r = metrics.agreement(metrics.contingency(a, b)).first()
    assert r.rand_index == pytest.approx(0.8) and metrics.agreement(metrics.contingency(a, a)).first().ari == 1.0
    with pytest.raises(ValueError):
        metrics.aligned_labels(a.withColumn("position", F.col("cell_id")), b.limit(2).withColumnRenamed("cluster_id", "label"))


def test_nonconflicting_equals_greedy(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(-2, 9)), sorted(set(rng.integers(0, 9, 2).tolist()))) for i in range(40)]
    got = {r.id for r in selection.nonconflicting(spark.createDataFrame(rows, "id long, delta double, touch array<long>"), search.saved).collect()}
    used, want = set(), set()
    for i, d, t in sorted(rows, key=lambda r: (-r[1], r[0])):
        if d > 0 and not used & set(t):
            used |= set(t)
            want.add(i)
    assert got == want


def test_nonconflicting_does_not_stop_early(spark):
    """A chain in which every round settles one move only."""
    n = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.range(132).selectExpr("id", "double(1000 - id) AS delta", "array(id, id + 1) AS touch")
        assert {r.id for r in selection.nonconflicting(rows, search.saved).collect()} == set(range(0, 132, 2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_best_move_among_many_clusters(spark):
    """Of 70 clusters that hold a cell's gene, its best target is the smallest one, outside the postings of 24."""
    m = np.zeros((71, 71), int)
    m[:70, 0], m[range(69), range(1, 70)] = range(140, 70, -1), 400
    m[70, 0] = 30
    z = [*range(70), 5]
    s = made(spark, m, z)
    prior, psi0 = flat(spark, 71, 0.5), 35.5
    moves = sweeps.best_cell_moves(s, s.cluster_gene, s.cluster_stat, prior, psi0).where("cell_id = 70").collect()
    assert [r.target for r in moves] == [69]
    assert moves[0].delta == pytest.approx(ll(m, [*range(70), 69], 0.5) - ll(m, z, 0.5))


def test_merging_all_is_found(spark):
    """Two equal cells: merging them gains under a strong prior."""
    s = made(spark, np.array([[9, 1], [9, 1]]))
    got = search.fit(s.counts, s.assign, 2.0, init="singletons", options=search.Options(proposals=0))
    assert got.labels.select("cluster_id").distinct().count() == 1


def test_audit_finds_the_mixture(spark):
    rng = np.random.default_rng(0)
    profiles = [(0.82, 0.12, 0.03, 0.03), (0.03, 0.03, 0.12, 0.82), (0.42, 0.08, 0.08, 0.42), (0.05, 0.80, 0.10, 0.05)]
    z = sum(([k] * n for k, n in enumerate((30, 30, 12, 30))), [])
    s = made(spark, np.array([rng.multinomial(120, profiles[k]) for k in z]), z)
    prior = P.audit_prior(s.counts, s.counts.select("gene_id").distinct())
    rows = {r.cluster_id: r for r in A.audit(s, prior, cell_diagnostics=True).collect()}
    assert {rows[2].best_parent_a, rows[2].best_parent_b} == {0, 1}
    assert 0.25 <= rows[2].lambda_map <= 0.75 and rows[2].expr_gain_vs_best_parent > 0
    assert all(rows[k].call == "likely_simplet" for k in (0, 1)) and 0.3 < rows[2].lambda_cell_median < 0.7
    few = A.audit(Partition(s.counts, s.assign.withColumn("cluster_id", F.lit(0).cast("long"))), prior).first()
    assert few.n_pairs_tested == 0 and few.call == "likely_simplet" and few.L_mix_best == -math.inf
    with pytest.raises(ValueError):
        A.audit(s, prior, rate=1.5)


def test_registered_audit_tests_all_pairs_of_fifty_parents(spark, monkeypatch):
    """Nine clusters have 28 pairs of parents each; with six parents only 15 of them."""
    rng = np.random.default_rng(5)
    z = np.repeat(np.arange(9), 3)
    m = np.array([rng.multinomial(60, rng.dirichlet(np.ones(5) * 0.5)) for _ in z])
    s = made(spark, m, z)
    given = registry._Given(s, 1.0)
    monkeypatch.setattr(registry, "_supplier", lambda *_: given)
    psi = m.sum(0) / m.sum()
    c = np.array([m[z == k].sum(0) for k in range(9)])
    q = (c + psi) / (c.sum(1, keepdims=True) + 1.0)
    pairs = [(t, a, b) for t in range(9) for a, b in combinations([k for k in range(9) if k != t], 2)]
    lam = np.arange(1, 100) / 100
    mix = {}
    for t, a, b in pairs:
        terms = (c[t] * np.log(lam[:, None] * q[a] + (1 - lam[:, None]) * q[b])).sum(1) + np.log(lam) + np.log(1 - lam) + math.log(6)
        mix[t, a, b] = terms.max() + math.log(np.exp(terms - terms.max()).sum()) - math.log(100)
    got = {(r.target, r.a, r.b): r.l_mix for r in registry.QUERIES["mixture_scores_top50"](spark, "").collect()}
    assert set(got) == set(pairs) and all(abs(got[p] - mix[p]) < 2e-3 for p in pairs)
    prior = registry.QUERIES["pair_prior_and_abundance_top50"](spark, "").collect()
    assert len(prior) == len(pairs) and all(r.pair_prior == pytest.approx(-math.log(28), abs=1e-5) for r in prior)
    # clusters of one size: the prior and the abundance are the same for all pairs of a target
    audit = {r.cluster_id: r for r in registry.QUERIES["audit_table_top50"](spark, "").collect()}
    for t in range(9):
        best = max((p for p in pairs if p[0] == t), key=mix.get)
        assert (audit[t].best_parent_a, audit[t].best_parent_b) == best[1:] and audit[t].n_pairs_tested == 28
    first = {t: min(p[1:] for p in pairs if p[0] == t) for t in range(9)}
    grid = np.arange(101) / 100
    with np.errstate(divide="ignore"):
        terms = {i: (m[i] * np.log(np.maximum(grid[:, None] * q[first[k][0]] + (1 - grid[:, None]) * q[first[k][1]], 1e-300))).sum(1) for i, k in enumerate(z.tolist())}
    lambdas = registry.QUERIES["cell_lambda_maps_top50"](spark, "").collect()
    assert len(lambdas) == 27 and all(terms[r.cell_id].max() - terms[r.cell_id][round(r["lambda"] * 100)] < 1e-6 for r in lambdas)


def test_merges_and_peels_that_cannot_be_raise(spark):
    s = made(spark, M, Z)
    for pairs in ([(0, 0)], [(0, 7)]):
        with pytest.raises(ValueError):
            s.merge(spark.createDataFrame(pairs, "cluster_a long, cluster_b long"))
    with pytest.raises(ValueError):
        s.peel(spark.createDataFrame([("x", 0), ("x", 1)], "block_id string, cell_id long"))


def test_numbers_over_many_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100_003).alias("v"))
    got = {r.v: r.n for r in numbered(df, "v", "n").collect()}
    assert [got[v] for v in sorted(got)] == list(range(5000))


def test_many_random_clusters(spark):
    """2,000 clusters in one expression; each has its seed, and sizes follow the weights."""
    cells = spark.range(20_000).select(F.col("id").alias("cell_id"))
    sizes = np.zeros(2000)
    for r in initial(None, cells, "random_online", 2000, 5).assign.groupBy("cluster_id").count().collect():
        sizes[r.cluster_id] = r["count"]
    w = np.array(urn_weights(2000, 5))
    want = 1 + 18_000 * w / w.sum()
    assert sizes.min() >= 1 and ((sizes - want) ** 2 / want).sum() < 2000 + 6 * math.sqrt(4000)


def test_optimised_tau(spark):
    rng = np.random.default_rng(2)
    m = rng.poisson(4, (12, 5))
    s = made(spark, m, [i % 3 for i in range(12)])
    pr = P.make_prior(s.counts, s.counts.select("gene_id").distinct(), 1.0)
    tau, best = P.optimise_tau(s, pr, 1.0)
    p = m.sum(0) / m.sum()
    grid = np.exp(np.linspace(math.log(1e-3), math.log(1e3), 4001))
    lls = [ll(m, [i % 3 for i in range(12)], t * p) for t in grid]
    assert best >= max(lls) - 1e-9 and abs(math.log(tau) - math.log(grid[int(np.argmax(lls))])) < 0.004
    with pytest.raises(ValueError):
        P.optimise_tau(s, pr.withColumn("psi", F.lit(0.0)), 1.0)


def test_draws(spark):
    stat = spark.createDataFrame([(i * 3, 1 + i % 3, 5) for i in range(6)], "cluster_id long, n_cells long, total long")
    rows = R.uniform_merges(stat, 3000, 1).collect()
    pairs = {(r.cluster_a, r.cluster_b): 0 for r in rows}
    for r in rows:
        pairs[r.cluster_a, r.cluster_b] += 1
    assert len(rows) == 3000 and len(pairs) == 15 and all(a < b for a, b in pairs) and sum((n - 200) ** 2 / 200 for n in pairs.values()) < 45
    near = spark.createDataFrame([(0, 1, 0.75, 1), (0, 2, 0.25, 2), (5, 0, 1.0, 1)], "source long, target long, share double, rank long")
    got = [(r.source, r.target) for r in R.biased_merges(near, 2000, 1).collect()]
    assert len(got) == 2000 and abs(got.count((0, 1)) - 750) < 120 and abs(got.count((5, 0)) - 1000) < 120
    one = stat.limit(1)
    assert R.uniform_merges(one, 10).count() == 0
    poor = spark.createDataFrame([(0, c, 1.0, c) for c in (1, 2, 3)], "cluster_id long, cell_id long, poor double, rank long")
    n = [r.cell_id for r in R.poor_draws(poor, 1200, 1).collect()]
    assert [abs(n.count(c) - w) < 100 for c, w in ((1, 600), (2, 400), (3, 200))] == [True] * 3


def test_fit_splits_and_never_falls(spark):
    m = np.array([[18, 2, 0, 0], [19, 1, 0, 0], [17, 3, 0, 0], [0, 0, 18, 2], [0, 0, 19, 1], [0, 0, 17, 3]])
    s = made(spark, m)
    got = search.fit(s.counts, s.assign, 1.0, init="one_cluster", max_rounds=6)
    labels = [r.cluster_id for r in got.labels.orderBy("cell_id").collect()]
    truth = [0, 0, 0, 1, 1, 1]
    agree = np.mean([(labels[i] == labels[j]) == (truth[i] == truth[j]) for i in range(6) for j in range(i)])
    assert agree > 0.8
    lls = [h["ll"] for h in got.history] + [got.ll]
    assert all(b >= a - 1e-8 for a, b in zip(lls, lls[1:]))
    with pytest.raises(ValueError):
        search.resolve_preset("none")


def test_registered_search_runs_until_gains_end(spark, monkeypatch):
    """Six kinds of cells in one cluster: one change a round, so two rounds leave it unfinished."""
    s = made(spark, 20 * np.eye(6, dtype=int), [0] * 6)
    monkeypatch.setattr(registry.tables, "user_events", lambda *_: s)
    labels = registry.QUERIES["fit_labels"](spark, "")
    assert labels.select("cluster_id").distinct().count() == 6
    assert cli.build_parser().parse_args(["fit", "in", "out"]).max_rounds == 0 and not any("max_rounds" in o for o in search.PRESETS.values())


def test_files_and_commands(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("GeneID\tA\tB\nG1\t1\t0\nG0\t\t0\nG2\t0\t2\n")
    out = cli.main(["convert", str(tmp_path / "m.tsv"), str(tmp_path / "m.npz")])
    assert (out["n_cells"], out["n_genes"], out["nnz"]) == (2, 2, 2)
    assert sorted(map(tuple, files.read_counts(spark, str(tmp_path / "m.npz")).collect())) == [(0, 0, 1), (1, 1, 2)]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% c\n2 2 2\n1 1 1\n2 2 2\n")
    assert sorted(map(tuple, files.read_counts(spark, str(tmp_path / "m.mtx")).collect())) == [(0, 0, 1), (1, 1, 2)]
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate integer symmetric\n2 2 2\n1 1 1\n2 1 5\n")
    assert sorted(map(tuple, files.read_counts(spark, str(tmp_path / "s.mtx")).collect())) == [(0, 0, 1), (0, 1, 5), (1, 0, 5)]
    (tmp_path / "one.tsv").write_text("GeneID\tA\tB\nG1\t1\t2\n")
    assert cli.main(["convert", str(tmp_path / "one.tsv"), str(tmp_path / "one.npz")])["n_genes"] == 1
    assert np.load(tmp_path / "one.npz")["shape"].tolist() == [2, 1]
    np.save(tmp_path / "m.npy", M)
    assert files.read_counts(spark, str(tmp_path / "m.npy")).count() == 6
    for bad in ("x.tsv", "x.txt"):
        with pytest.raises(ValueError):
            files.read_counts(spark, str(tmp_path / bad))
    (tmp_path / "z.txt").write_text("0\n0\n1\n1\n")
    out = cli.main(["audit-doublets", str(tmp_path / "m.npy"), str(tmp_path / "z.txt"), str(tmp_path / "audit")])
    assert out["calls"] == {"likely_simplet": 2} and json.loads((tmp_path / "audit.json").read_text())["n_cells"] == 4
    assert files.find_files(spark, str(tmp_path), "*.tsv")[0].endswith("m.tsv")


def test_words_of_documents_are_counted_without_a_shuffle(spark, tmp_path):
    from sparsefold.sources import tables

    rows = [(1, "b A b-c  a", "src2"), (2, None, "src1"), (3, "", "src1"), (4, "x", None), (5, "é 12", "src1")]
    for name, more in (("once", []), ("again", [(4, "x y", None)]), ("none", [(None, "q q", "src3")])):
        spark.createDataFrame(rows + more, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        s = tables.document_words(spark, f"{tmp_path}/{name}")
        want = {(1, "a"): 2, (1, "b"): 2, (1, "c"): 1, (4, "x"): 1 + (name == "again")} | ({(4, "y"): 1} if name == "again" else {}) | ({(None, "q"): 2} if name == "none" else {})
        assert {(r.cell_id, r.gene_id): r.cnt for r in s.counts.collect()} == want
        assert ("Exchange" in s.counts._jdf.queryExecution().executedPlan().toString()) == (name != "once")
        got = {(r.cluster_id, r.gene_id): r.cnt for r in s.cluster_gene.collect()}
        joined = s.counts.join(s.assign, "cell_id").groupBy("cluster_id", "gene_id").agg(F.sum("cnt").alias("cnt"))
        assert got == {(r.cluster_id, r.gene_id): r.cnt for r in joined.collect()}
