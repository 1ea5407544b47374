"""Connected components by alternating stars: every step is a grouped minimum and a join on written tables.

Before the first and after each step, the edges that a task reads are replaced by stars that connect the same nodes,
a bounded run of them at a time, so that chains within a task need no steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, save, ship

#: Edges of a task that writes a step's table; edges that a task replaces by stars at a time (16 MB).
TASK_ROWS = 100_000
RUN = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node but the least of its component to that one, for the components of the edges given."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while ((up := root[root]) != root).any():
            root = up
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(a, b)], names=["a", "b"])

    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        n += len(batch)
        if n >= RUN:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _contract(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_contracted, "a long, b long")


def _star(edges: DataFrame, both: bool, tasks: int) -> DataFrame:
    """One star step over edges with a > b: neighbours (larger ones, or with ``both`` false the smaller) are linked to the least of them."""
    if both:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = save(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks), "star")
    met = around.join(least, "u")
    if both:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(tasks)
    out = save(out if both else _contract(out), "edges")
    drop(least)
    return out


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller and a larger one; otherwise every component is a star around its least node."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return bool(ends.where("down > 1 or (down > 0 and up > 0)").limit(1).count())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of whole numbers -> (node, component): the least node reachable, for every node that has an edge to another.

    Nulls and loops are left out. A hub's edges are aggregated before the shuffle, and the join that deals
    them out reads written tables, so Spark can split its key. Steps are written by as many tasks as the edges
    ask for, as there are many steps and small edge tables would be cut into a file per shuffle partition.
    """
    ship(edges.sparkSession)
    whole = [F.col(c).cast("long").alias(c) for c in ("a", "b")]
    first = save(_contract(edges.where("a <> b").select(*whole)), "edges")
    tasks = 1 + first.count() // TASK_ROWS
    now = save(_contract(first.coalesce(tasks)), "edges")
    drop(first)
    while _unfinished(now):
        large = _star(now, True, tasks)
        drop(now)
        now = _star(large, False, tasks)
        drop(large)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
