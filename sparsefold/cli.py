"""Commands: convert, fit, audit-doublets. Files are given by option, or in the order of the options."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import audit as A
from .operators import prior as P
from .operators.model import Partition
from .plans import search
from .sources import files

#: Starts by name, and what each means here: a kind of start and the share of the default number of clusters.
INITS = {"singletons": None, "one_cluster": None, "random": None, "random_online": None, "overlap_graph": 1.0, "leiden_overclustered": 1.0, "leiden_less_overclustered": 0.5}
#: Modes and policies, and the families of proposals that each stands for.
MODES = {"effective": "staged", "gpu": "structured", "cpu-only": "flat"}
POLICIES = {"cellstates_like": "staged", "gpu_structured": "structured", "gpu_fast_weak": "structured"}


def _cells(spark, n: int):
    return spark.range(n).select(F.col("id").alias("cell_id"))


def run_convert(spark, args) -> dict:
    counts = files.read_wide_tsv(spark, args.input).persist()
    names, genes = files.tsv_names(spark, args.input)
    n_genes = genes.count()
    if args.output.endswith(".npz"):
        files.write_npz(counts, args.output, len(names), n_genes)
    else:
        files.write_counts(counts, args.output)
    return {"n_cells": len(names), "n_genes": n_genes, "nnz": counts.count(), "output": args.output}


def options_of(args) -> search.Options:
    """What the options of the command change in a preset."""
    made = search.Options(**search.resolve_preset(args.preset))
    weights = POLICIES.get(args.search_policy) or MODES.get(args.optimizer_mode)
    given = {"weights": weights, "proposals": args.n_proposals, "cap": args.max_scored_proposals, "walk": args.random_accept_prob, "walk_share": args.random_accept_max_fraction, "uniform_share": 1.0 if args.random_proposals else None}
    return replace(made, **{k: v for k, v in given.items() if v is not None})


def run_fit(spark, args) -> dict:
    counts = files.read_counts(spark, args.input).persist()
    n_cells, n_genes = files.read_shape(spark, args.input)
    cells = _cells(spark, n_cells)
    share = INITS[args.init]
    target = args.n_clusters or args.target_clusters
    if share is not None and target is None:
        target = max(1, int(search.overclustered_target(n_cells) * share))
    init = files.read_labels(spark, args.init_labels) if args.init_labels else "overlap_graph" if share is not None else args.init
    shown = {"progress": ("restart", "round", "ll", "clusters", "gain"), "verbose": None}
    report = None
    if args.progress or args.verbose:
        report = lambda r: print(json.dumps(r if args.verbose else {k: r[k] for k in shown["progress"]}), flush=True)
    got = search.fit(
        counts, cells, args.tau, init, max_rounds=max(0, args.max_rounds), restarts=args.restarts or 1, eta=args.eta or 0.0, window=args.improvement_window or 5, stall=args.stall_rounds or 1,
        backend=args.backend, seed=args.seed, update_tau=args.update_tau or (1 if args.update_psi else 0), options=options_of(args), target=target, report=report,
    )
    files.write_labels(got.labels, args.output)
    summary = {
        "n_cells": n_cells, "n_genes": n_genes, "n_clusters": got.labels.select("cluster_id").distinct().count(), "log_likelihood": got.ll, "tau": got.tau, "stop_reason": got.stop_reason, "rounds": len(got.history),
        "preset": args.preset, "backend": args.backend, "seed": args.seed, "init": args.init, "improvement_window": args.improvement_window or 5, "eta": args.eta or 0.0, "output": args.output, "history": got.history,
    }
    files.write_summary(summary, args.summary_json or args.output + ".json")
    return summary


def run_audit(spark, args) -> dict:
    counts = files.read_counts(spark, args.input).persist()
    labels = files.read_labels(spark, args.labels)
    state = Partition(counts, labels)
    prior = P.audit_prior(counts, counts.select("gene_id").distinct(), args.tau).persist()
    got = A.audit(state, prior, args.doublet_rate, args.top_m_parents, args.lambda_grid_size, homotypic=args.include_homotypic, cell_diagnostics=args.return_cell_lambda).persist()
    files.write_tsv(got.orderBy("cluster_id"), args.output)
    calls = {r["call"]: r["count"] for r in got.groupBy("call").count().collect()}
    summary = {"n_cells": labels.count(), "n_clusters": got.count(), "calls": calls, "doublet_rate": args.doublet_rate, "top_m_parents": args.top_m_parents, "output": args.output}
    files.write_summary(summary, args.summary_json or args.output + ".json")
    return summary


def _paths(parser: argparse.ArgumentParser, *names: str) -> None:
    for name in names:
        parser.add_argument(f"_{name}", metavar=name, nargs="?")
        parser.add_argument(f"--{name}")


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparsefold")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="wide TSV to Parquet (or .npz)")
    _paths(c, "input", "output")
    f = sub.add_parser("fit", help="search for a partition")
    _paths(f, "input", "output")
    f.add_argument("--preset", default="balanced", choices=list(search.PRESETS))
    f.add_argument("--optimizer-mode", choices=list(MODES))
    f.add_argument("--search-policy", choices=list(POLICIES))
    f.add_argument("--backend", default="auto", choices=search.BACKENDS)
    f.add_argument("--init", default="overlap_graph", choices=list(INITS))
    f.add_argument("--init-labels")
    f.add_argument("--n-clusters", type=int)
    f.add_argument("--target-clusters", type=int)
    f.add_argument("--tau", type=float)
    f.add_argument("--update-tau", type=int, default=0, help="fit tau anew after so many rounds")
    f.add_argument("--update-psi", action="store_true", help="fit tau anew after each round")
    f.add_argument("--restarts", type=int)
    f.add_argument("--n-proposals", type=int)
    f.add_argument("--max-scored-proposals", type=int)
    f.add_argument("--random-proposals", action="store_true")
    f.add_argument("--guided-proposals", dest="random_proposals", action="store_false")
    f.add_argument("--random-accept-prob", type=float)
    f.add_argument("--random-accept-max-fraction", type=float)
    f.add_argument("--max-rounds", type=int, default=0, help="0: until no round gains")
    f.add_argument("--stall-rounds", type=int)
    f.add_argument("--improvement-window", type=int)
    f.add_argument("--eta", type=float)
    f.add_argument("--seed", type=int, default=1)
    # of other back ends: taken, without effect here
    for name in ("--threads", "--proposal-workers", "--proposal-batch-size", "--cuda-chunk-size"):
        f.add_argument(name, type=int)
    for name in ("--fast-ll-tracking", "--recompute-ll-each-round", "--cuda-empty-cache", "--validate-batches"):
        f.add_argument(name, action="store_true")
    a = sub.add_parser("audit-doublets", help="which clusters look like mixtures")
    _paths(a, "input", "labels", "output")
    a.add_argument("--tau", type=float, default=1.0)
    a.add_argument("--doublet-rate", type=float, default=0.05)
    a.add_argument("--top-m-parents", type=int, default=50)
    a.add_argument("--lambda-grid-size", type=int, default=101)
    a.add_argument("--include-homotypic", action="store_true")
    a.add_argument("--return-cell-lambda", action="store_true")
    for p in (f, a):
        p.add_argument("--summary-json")
    for p in (c, f, a):
        p.add_argument("--progress", action="store_true")
        p.add_argument("--verbose", action="store_true")
    return top


def parsed(argv: list[str] | None = None) -> argparse.Namespace:
    parser = build_parser()
    args = parser.parse_args(argv)
    for name in ("input", "labels", "output"):
        if hasattr(args, f"_{name}"):
            value = getattr(args, name) or getattr(args, f"_{name}")
            if value is None:
                parser.error(f"--{name} is needed")
            setattr(args, name, value)
    return args


def main(argv: list[str] | None = None) -> dict:
    args = parsed(argv)
    spark = SparkSession.builder.appName("sparsefold").getOrCreate()
    return {"convert": run_convert, "fit": run_fit, "audit-doublets": run_audit}[args.command](spark, args)


if __name__ == "__main__":
    print(main())
