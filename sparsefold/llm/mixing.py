"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected until the
weights have a target entropy, or until no source is repeated more than a limit. Each source's quota of the
token budget is then realised by block permutations: a source is dealt into blocks by hash, whose number follows the rows;
each epoch reads all its blocks in a keyed order, and the last, partial epoch reads whole blocks in that
order until the quota would be passed, then documents of the block at the boundary in keyed order. Budgets
are kept to within one document (or group of equal rows) per source.

Tokens are words. Their counts are written once, with the place of each document; only source and block totals
are aggregated from them, and the running sums go over one source's blocks (one for about ``BLOCK_ROWS`` rows)
and over one block's documents. The documents themselves meet a table of one row per source and are not
shuffled. A bisection step reads the source totals only; five steps are taken per job. A target that no exponent
meets raises.

Defined cases: a very long text is one document, drawn whole; null source is a source; null or empty text has no tokens and such documents follow their
block; a source without tokens is read once; equal rows are drawn together; an empty table gives no rows;
input columns named like an output give way.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import WORD, drop, extended, hidden, revealed, save, without

OUTPUT = ["n_tokens", "weight", "epoch", "mix_at"]
BROADCAST_SOURCES = 100_000
STEPS = 5
#: Rows of the table for each block of a source beyond the first 1024.
BLOCK_ROWS = 100_000


def exponent(totals: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> tuple[float, float]:
    """Bisect the exponent for source ``tokens``; returns it and the budget in tokens.

    ``entropy`` is in nats: the largest exponent in 0 .. 8 whose weights reach it. ``max_repeats``: the
    smallest in 0 .. 1 at which no source is read more often. Without a budget, it is the least at which
    every source is read once in full. An entropy above that of equal weights or below that of exponent 8, repeats
    under one, and repeats that the budget exceeds with the sources' own shares cannot be met and raise.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give entropy or max_repeats")
    tokens = totals.where("tokens > 0")
    total = tokens.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0, 0.0
    if max_repeats is not None and max_repeats < 1:
        raise ValueError("max_repeats must be 1 or more")
    share = tokens.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def at(points):
        cols = []
        for i, a in enumerate(points):
            cols += [F.sum(F.pow("p", F.lit(a))).alias(f"z{i}"), F.sum(F.pow("p", F.lit(a)) * F.log("p")).alias(f"m{i}"), F.max(F.pow("p", F.lit(a - 1))).alias(f"r{i}"), F.max(F.pow("p", F.lit(1 - a))).alias(f"c{i}")]
        row = share.agg(*cols).first()
        out = []
        for i, a in enumerate(points):
            z, m, r, c = (row[f"{k}{i}"] for k in "zmrc")
            spent = total * z * c if budget is None else budget
            out.append({"entropy": math.log(z) - a * m / z, "repeats": spent / total * r / z, "budget": spent})
        return out

    lo, hi = (0.0, 8.0) if entropy is not None else (0.0, 1.0)
    # the condition holds below the answer for entropy, and above it for repeats
    holds = (lambda x: x["entropy"] >= entropy) if entropy is not None else (lambda x: x["repeats"] > max_repeats + 1e-12)
    ends = at([lo, hi])
    if entropy is not None and not ends[1]["entropy"] - 1e-9 <= entropy <= ends[0]["entropy"] + 1e-9:
        raise ValueError(f"the entropy must be {ends[1]['entropy']:.6f} to {ends[0]['entropy']:.6f}")
    if max_repeats is not None and holds(ends[1]):
        raise ValueError(f"the budget repeats sources {ends[1]['repeats']:.3f} times even at their own shares")
    for _ in range(6):
        n = 2**STEPS
        points = [lo + (hi - lo) * i / n for i in range(1, n)]
        below = [holds(x) for x in at(points)]
        i = below.index(False) if False in below else n - 1
        lo, hi = ([lo, *points][i], [*points, hi][i])
    alpha = lo if entropy is not None else hi
    return alpha, at([alpha])[0]["budget"]


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 7, blocks: int = 1024) -> DataFrame:
    """One row per draw: the columns of ``docs``, ``n_tokens``, ``weight`` of its source, ``epoch`` from 0, and ``mix_at`` in 0 .. 1.

    Ordering by ``mix_at`` interleaves the sources in the proportion of their weights.
    """
    docs, names = hidden(without(docs, OUTPUT))
    text, source, key = names[text], names[source], names[key]
    place = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    count = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    counted = save(docs.select(F.col(source).alias("s"), place.alias("_place"), count.alias("n_tokens")), "mix-counts")
    blocks = max(blocks, counted.count() // BLOCK_ROWS)
    block = lambda of: F.pmod(F.xxhash64(F.lit(seed + 1), of), F.lit(blocks))
    order = lambda of: F.xxhash64(F.lit(seed + 2), of, F.col("_block"))
    counted = counted.withColumn("_block", block(F.col("_place")))
    by_block = save(counted.groupBy("s", "_block").agg(F.sum("n_tokens").alias("tokens")).withColumn("_order", order(F.col("s"))), "mix-blocks")
    totals = by_block.groupBy("s").agg(F.sum("tokens").alias("tokens"))
    alpha, spent = exponent(totals, entropy, max_repeats, budget)
    z = totals.where("tokens > 0").agg(F.sum(F.pow("tokens", F.lit(alpha)))).first()[0] or 1.0
    weight = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha)) / F.lit(z)).otherwise(0.0)
    plan = totals.select("s", "tokens", weight.alias("weight"))
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(spent) / F.col("tokens")).otherwise(1.0)
    plan = plan.withColumn("quota", epochs).withColumn("full", F.floor(F.col("quota") + 1e-9)).withColumn("rest", F.greatest(F.lit(0.0), (F.col("quota") - F.col("full")) * F.col("tokens")))
    # the block at which a source's partial epoch ends
    along = Window.partitionBy("s").orderBy("_order", "_block").rowsBetween(Window.unboundedPreceding, 0)
    named = plan.select(F.col("s").alias("p_s"), "weight", "quota", "full", "rest")
    runs = by_block.withColumn("upto", F.sum("tokens").over(along)).join(named, F.col("s").eqNullSafe(F.col("p_s")))
    edge = runs.where(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min(F.struct("_order", "_block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("edge"))
    edge = edge.select(F.col("s").alias("e_s"), "edge.*")
    few = by_block.select("s").distinct().count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda df: df)
    # and the document at which it ends inside that block
    inside = counted.join(hint(edge.select(F.col("e_s"), F.col("_block").alias("e_block"), "left")), F.col("s").eqNullSafe(F.col("e_s")) & (F.col("_block") == F.col("e_block")))
    peers = Window.partitionBy("e_s").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("upto", F.sum("n_tokens").over(peers)).where(F.col("upto") <= F.col("left")).groupBy("e_s").agg(F.max("_place").alias("last"))
    inside = inside.withColumnRenamed("e_s", "i_s")
    whole = named.join(edge, F.col("p_s").eqNullSafe(F.col("e_s")), "left").join(inside, F.col("p_s").eqNullSafe(F.col("i_s")), "left")
    whole = save(whole.select("p_s", "weight", "quota", "full", F.col("_order").alias("e_order"), F.col("_block").alias("e_block"), "last"), "mix-plan")
    drop(by_block)
    drop(counted)
    rows = extended(docs, {"n_tokens": count, "_place": place, "_block": block(place)})
    rows = rows.join(hint(whole), F.col(source).eqNullSafe(F.col("p_s"))).withColumn("_order", order(F.col(source)))
    before = F.col("e_order").isNull() | (F.struct("_order", "_block") < F.struct("e_order", "e_block"))
    at_edge = (F.col("_block") == F.col("e_block")) & (F.col("_place") <= F.col("last"))
    partial = (F.col("quota") > F.col("full") + 1e-9) & F.coalesce(before | at_edge, F.lit(False))
    draws = (F.col("full") + F.when(partial, 1).otherwise(0)).cast("int")
    rows = rows.withColumn("_draws", draws).where("_draws > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_draws") - 1)))
    # places of blocks in the epoch, then of documents in the block, as numbers in 0 .. 1
    u = lambda c: (c.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    later = F.when(F.col("epoch") == F.col("full"), u(F.col("_order"))).otherwise(u(F.xxhash64("_order", "epoch")))
    mix_at = (F.col("epoch") + later + u(F.xxhash64("_place", "epoch")) / F.lit(2.0**20)) / F.greatest(F.col("quota"), F.lit(1e-12))
    return revealed(rows.withColumn("mix_at", F.least(mix_at, F.lit(1.0))), names, *OUTPUT)
