"""Archives read by tasks, shapes that are kept, the generator, and the options of the commands."""

import json

import numpy as np
import pytest

from sparsefold import cli
from sparsefold.operators import metrics
from sparsefold.plans import search
from sparsefold.sources import archives, files, synthetic


def dense(rows, shape):
    out = np.zeros(shape)
    for r in rows:
        out[r.cell_id, r.gene_id] = r.cnt
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_archives_are_read_by_ranges_of_rows(spark, tmp_path, packed):
    m = np.random.default_rng(1).poisson(0.4, (50, 9))
    m[45:], m[:, 8] = 0, 0  # no counts in the last cells and the last gene
    r, c = np.nonzero(m)
    path = str(tmp_path / "m.npz")
    (np.savez_compressed if packed else np.savez)(path, data=m[r, c], indices=c.astype(np.int32), indptr=np.concatenate(([0], np.cumsum(np.count_nonzero(m, 1)))), shape=np.array(m.shape), format=np.array(b"csr"))
    archives.register(spark)
    got = spark.read.format("csr_archive").option("path", path).option("rows", 7).load()
    assert got.rdd.getNumPartitions() == 8 and (dense(got.collect(), m.shape) == m).all()
    assert files.read_shape(spark, path) == (50, 9) and files.read_counts(spark, path).count() == len(r)
    np.save(tmp_path / "m.npy", m)
    got = spark.read.format("dense_array").option("path", str(tmp_path / "m.npy")).option("rows", 20).load()
    assert got.rdd.getNumPartitions() == 3 and (dense(got.collect(), m.shape) == m).all() and files.read_shape(spark, str(tmp_path / "m.npy")) == (50, 9)
    np.save(tmp_path / "bad.npy", np.zeros(3))
    with pytest.raises(Exception, match="two dimensions"):
        files.read_counts(spark, str(tmp_path / "bad.npy")).count()


def test_size_lines_and_names(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n5 7 2\n1 1 1\n2 2 2\n")
    assert files.read_shape(spark, str(tmp_path / "m.mtx")) == (5, 7)
    (tmp_path / "m.tsv").write_text("GeneID\tA\tB\nG1\t\t0\nG2\t3\t0\nG3\t0.4\t0\nG4\t0\t2\n")
    cells, genes = files.tsv_names(spark, str(tmp_path / "m.tsv"))
    assert cells == ["A", "B"] and {(r.gene_id, r.gene) for r in genes.collect()} == {(0, "G2"), (1, "G4")}
    assert {tuple(r) for r in files.read_wide_tsv(spark, str(tmp_path / "m.tsv")).collect()} == {(0, 0, 3), (1, 1, 2)}
    files.write_counts(files.read_wide_tsv(spark, str(tmp_path / "m.tsv")), str(tmp_path / "t.parquet"))
    assert files.read_shape(spark, str(tmp_path / "t.parquet")) == (2, 2)


def test_generator(spark):
    got = synthetic.generate(spark, 4, 30, 40, 50, 60, seed=3)
    rows, labels = got.counts.collect(), {r.cell_id: r.cluster_id for r in got.labels.collect()}
    totals = np.zeros(120)
    for r in rows:
        totals[r.cell_id] += r.cnt
    assert len(labels) == 120 and set(labels.values()) == set(range(4)) and ((50 <= totals) & (totals <= 60)).all() and len(set(totals)) > 5
    m = dense(rows, (120, 40))
    assert all(m[30 * k : 30 * k + 30, 10 * k : 10 * k + 10].sum() > 0.8 * m[30 * k : 30 * k + 30].sum() for k in range(4))
    p = dense([_P(r) for r in got.profiles.collect()], (4, 40))
    assert p.sum(1) == pytest.approx(np.ones(4)) and abs(m[:30].sum(0) / m[:30].sum() - p[0]).max() < 0.03
    again = synthetic.generate(spark, 4, 30, 40, 50, 60, seed=3).counts.repartition(3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


class _P:
    def __init__(self, r):
        self.cell_id, self.gene_id, self.cnt = r.cluster_id, r.gene_id, r.p


def test_reports_of_runs(spark):
    history = spark.createDataFrame([(0, {"a": 1.0, "b": 2.0}), (1, {"a": 0.5})], "round long, timing_s map<string, double>")
    assert {r.phase: r.seconds for r in metrics.timing_totals(history).collect()} == {"a": 1.5, "b": 2.0}
    runs = [("x", "completed", 2.0, 0.5, 3.0, -1.0), ("x", "completed", 4.0, 0.7, 5.0, -3.0), ("x", "failed", 9.0, 0.0, 0.0, 0.0), ("y", "timeout", 1.0, None, None, None)]
    got = {r.method: r for r in metrics.run_means(spark.createDataFrame(runs, "method string, status string, elapsed_s double, ari_vs_truth double, n_clusters double, log_likelihood double")).collect()}
    assert (got["x"].n_runs, got["x"].mean_elapsed_s, got["x"].mean_ari_vs_truth, got["x"].mean_log_likelihood) == (2, 3.0, pytest.approx(0.6), -2.0)
    assert got["y"].n_runs == 0 and got["y"].mean_elapsed_s is None


def test_options_of_the_commands():
    a = cli.parsed(["fit", "--input", "m.npz", "--output", "z.npy", "--summary-json", "s.json", "--preset", "quality", "--n-proposals", "9", "--random-proposals", "--search-policy", "gpu_structured", "--random-accept-prob", "0.1"])
    got = cli.options_of(a)
    assert (a.input, a.output, a.summary_json) == ("m.npz", "z.npy", "s.json")
    assert (got.proposals, got.uniform_share, got.weights, got.walk, got.cell_passes) == (9, 1.0, "structured", 0.1, search.PRESETS["quality"]["cell_passes"])
    assert cli.parsed(["convert", "a", "b"]).output == "b" and cli.options_of(cli.parsed(["fit", "a", "b"])) == search.Options()
    with pytest.raises(SystemExit):
        cli.parsed(["fit", "a"])


def test_fit_keeps_cells_without_counts(spark, tmp_path, capsys):
    np.savez(tmp_path / "m.npz", data=np.array([9, 8]), indices=np.array([0, 0], np.int32), indptr=np.array([0, 1, 2, 2]), shape=np.array([3, 2]))
    out = cli.main(["fit", "--input", str(tmp_path / "m.npz"), "--output", str(tmp_path / "z.npy"), "--summary-json", str(tmp_path / "s.json"), "--init", "singletons", "--tau", "2", "--max-rounds", "1", "--progress"])
    assert len(np.load(tmp_path / "z.npy")) == 3 and out["n_cells"] == 3 and out["n_genes"] == 2
    assert json.loads((tmp_path / "s.json").read_text())["stop_reason"] == out["stop_reason"] and '"ll"' in capsys.readouterr().out
