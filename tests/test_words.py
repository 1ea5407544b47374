import pytest
from pyspark.sql import functions as F

from sparsefold.operators import likelihood as L
from sparsefold.operators import ranking
from sparsefold.operators.model import Partition
from sparsefold.plans import registry
from sparsefold.sources import tables


@pytest.fixture()
def docs(spark, tmp_path):
    rows = [(0, "The cat, the CAT sat", "site1"), (1, None, "site1"), (2, "...", "site2"), (3, "a b c a a", None), (4, "x", "site2"), (5, " end sat ", "site1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_sums_of_words_equal_sums_of_counts(spark, docs):
    s = tables.document_words(spark, docs)
    plain = Partition(s.counts, s.assign, labelled=s.labelled)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(s.counts) == sorted([(0, "the", 2), (0, "cat", 2), (0, "sat", 1), (3, "a", 3), (3, "b", 1), (3, "c", 1), (4, "x", 1), (5, "end", 1), (5, "sat", 1)], key=str)
    assert rows(s.cluster_gene) == rows(plain.cluster_gene)
    assert rows(s.cluster_stat) == rows(plain.cluster_stat)


@pytest.mark.parametrize("most", [0, 1, 3, 100])
def test_join_by_size_keeps_all_rows(spark, most):
    table = spark.createDataFrame([(f"g{i}", float(1 + i % 4)) for i in range(9)], "gene_id string, psi double")
    rows = spark.createDataFrame([(i, f"g{i % 11}") for i in range(60)], "cell_id long, gene_id string")
    got = L.met_by_size(rows, table, ["gene_id"], "psi", most)
    assert sorted(map(tuple, got.select("cell_id", "psi").collect())) == sorted(map(tuple, rows.join(table, "gene_id").select("cell_id", "psi").collect()))


def test_rare_genes_only_are_shuffled(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_GENES", 3)
    s = tables.document_words(spark, docs)
    prior = s.counts.groupBy("gene_id").agg(F.sum("cnt").cast("double").alias("psi"))
    got = L.cell_ll(s.counts, s.assign.select("cell_id", F.lit(1).alias("total")), prior, 1.0)
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 6


def test_violations_keep_their_number(spark):
    counts = spark.createDataFrame([(0, "a", 2), (1, "a", 1), (1, "b", 4)], "cell_id long, gene_id string, cnt long")
    state = Partition(counts, spark.createDataFrame([(0, 0), (1, 1)], "cell_id long, cluster_id long"))
    kept = state.cluster_gene.where("gene_id = 'a'")
    bad = kept.unionByName(kept.where("cluster_id = 0")).unionByName(kept.where("cluster_id = 0"))
    got = state.violations(bad, state.cluster_stat)
    assert sorted(r.row for r in got.collect()) == ['{"cluster_id":0,"gene_id":"a","cnt":2}'] * 2 + ['{"cluster_id":1,"gene_id":"b","cnt":4}']
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [cluster_id") <= 8


@pytest.mark.parametrize("name", ["merge_pair_scores", "state_validate"])
def test_counts_by_cell_are_not_written(spark, monkeypatch, name):
    written = []
    saved = registry.saved
    monkeypatch.setattr(registry, "saved", lambda df: written.append(df.columns) or saved(df))
    registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert written and not any("cell_id" in c for c in written)


@pytest.mark.parametrize("again", [False, True])
def test_pairs_of_seeds_and_cells_are_not_shuffled(spark, tmp_path, monkeypatch, again):
    """Many blocks of seeds, and batches of few rows; ``again``: a doc_id that repeats and one that is null."""
    duckdb = pytest.importorskip("duckdb")
    for name, value in (("SEED_GENES", 7), ("CELLS_AT_ONCE", 2), ("PAIR_ROWS", 3), ("BITS", 0.3)):
        monkeypatch.setattr(ranking, name, value, raising=False)
    words = "all one two three four five six seven eight nine".split()
    rows = [(i, " ".join(words[(i * k) % (2 + i % 9)] for k in range(i % 23)), f"site{i % 3}" if i % 7 else None) for i in range(0, 900, 10)]
    rows += [(-100, "all two", "site9"), (905, None, "site1"), (906, 'zebra "q"', "site1")] + [(100, "six six all", "site1"), (None, "all nine", "site2")] * again
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["rare_overlap"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(seed_id" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["rare_overlap"]).fetchall()
    assert got.columns == ["seed_id", "cell_id", "overlap"] and len(want) > 500
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
