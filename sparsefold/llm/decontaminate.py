"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, marks and digits of any script, lower-cased and hashed. The runs of ``tile`` words of all
texts, their seeds, are joined to those of the benchmark items by a running Karp-Rabin hash. A text and an item whose
shared seeds cover enough of the item to reach the threshold are tiled: the longest match of words not yet marked is
marked in both, again and again, until none of ``tile`` words is left. The share of the item's words in tiles is its
coverage, so a passage that was reordered in pieces is caught like a verbatim one. A document is contaminated when an
item's coverage reaches ``threshold``.

Texts are known by two 64-bit hashes, so equal texts are tiled once. Seeds of the benchmark are few: up to a bound they
go to the tasks, which then send on only seeds that an item has; beyond it, all seeds are joined by a shuffle. Only texts
that share enough seeds are moved, and the result is joined to the documents by the hashes of their texts.

Defined cases: null or empty texts share no seed; a very long text is worked on whole; an item without words matches
nothing, nor does one of under ``tile`` words, as it would mark common phrases; an item without item_id counts like any
other, and after those with one of equal coverage; repeated items count once per row; ties between items go to the
smallest item_id; repeated rows get equal results; an empty benchmark leaves every document clean; input columns named
like an output give way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import hidden, revealed, save, ship, without
from .tokens import U, chunks, mix64, powers, span_hashes, word_spans

OUTPUT = {"contaminated": "boolean", "coverage": "double", "item_id": "long", "n_items": "int", "n_tiles": "int"}
#: Seeds of the benchmark (8 bytes each) and rows that may be broadcast.
BROADCAST_SEEDS = 4_000_000
BROADCAST_ROWS = 200_000
#: Pairs of equal seeds that are held at once.
PAIRS = 1 << 20
APART = r"[^\p{L}\p{M}\p{N}]+"


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, word hashes and row bounds in them."""
    bare = pc.replace_substring_regex(pc.utf8_lower(column), pattern=APART, replacement=" ")
    for first, end, data, offsets in chunks(bare):
        starts, ends, row = word_spans(data, offsets)
        yield first, end, span_hashes(data, starts, ends), np.searchsorted(row, np.arange(end - first + 1))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each run of ``k`` words, by differences of one running polynomial."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    power, inverse = powers(len(words) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(words * power[: len(words)])))
    return mix64((total[k:] - total[:-k]) * inverse[:n])


def _starts(test: np.ndarray, text: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Where matches of ``least`` words or more begin."""
    ha, hb = runs(test, least), runs(text, least)
    order = np.argsort(ha, kind="stable")
    lo, hi = np.searchsorted(ha[order], hb, "left"), np.searchsorted(ha[order], hb, "right")
    near = np.flatnonzero(hi > lo)
    upto = np.cumsum(hi[near] - lo[near])
    at = 0
    while at < len(near):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        j = np.repeat(near[at:end], hi[near[at:end]] - lo[near[at:end]])
        within = np.arange(len(j)) - np.repeat(np.append(0, upto[at:end][:-1] - (upto[at - 1] if at else 0)), hi[near[at:end]] - lo[near[at:end]])
        i = order[lo[j] + within]
        inner = (i > 0) & (j > 0) & (test[np.maximum(i, 1) - 1] == text[np.maximum(j, 1) - 1])
        yield from zip(i[~inner].tolist(), j[~inner].tolist())
        at = end


def tiles(test: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in test, place in text, length) of non-overlapping matches, longest first.

    Matches wait in a heap; one that has been marked in part goes back with the runs that are left of it.
    """
    marked_a, marked_b = np.zeros(len(test), bool), np.zeros(len(text), bool)
    waiting = []
    for i, j in _starts(test, text, least):
        most = min(len(test) - i, len(text) - j)
        apart = np.flatnonzero(test[i : i + most] != text[j : j + most])
        n = int(apart[0]) if len(apart) else most
        if n >= least:
            waiting.append((-n, i, j))
    heapq.heapify(waiting)
    found = []
    while waiting:
        n, i, j = heapq.heappop(waiting)
        n = -n
        taken = marked_a[i : i + n] | marked_b[j : j + n]
        if not taken.any():
            marked_a[i : i + n] = marked_b[j : j + n] = True
            found.append((i, j, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(waiting, (-(b - a), i + a, j + b - (b - a)))
    return found


def _item_seeds(tile: int):
    """(key, text) -> (key, n_words, place, seed) of each seed of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, words, bounds in word_hashes(batch.column(1)):
                for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    h = runs(words[a:b], tile)
                    n = len(h)
                    columns = [pa.array([batch.column(0)[first + r].as_py()] * n, pa.int64()), pa.array(np.full(n, b - a, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "n_words", "place", "seed"])

    return run


def _text_seeds(tile: int, known):
    """(h1, h2, text) -> (h1, h2, seed) of each distinct seed of a text, of those in ``known`` if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, _, words, bounds in word_hashes(batch.column(2)):
                seed = runs(words, tile).view(np.int64)
                if known is not None:
                    held = known.value
                    at = np.minimum(np.searchsorted(held, seed), len(held) - 1)
                    place = np.flatnonzero(held[at] == seed)
                else:
                    place = np.arange(len(seed))
                row = np.searchsorted(bounds, place, "right") - 1
                ok = place + tile <= bounds[row + 1]
                row, seed = row[ok], seed[place[ok]]
                order = np.lexsort((seed, row))
                row, seed = row[order], seed[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
                row, seed = first + row[new], seed[new]
                yield pa.RecordBatch.from_arrays([pa.array(h1[row]), pa.array(h2[row]), pa.array(seed)], names=["h1", "h2", "seed"])

    return run


def _tiled(tile: int):
    """(h1, h2, item_id, times, item_text, text) -> coverage and number of tiles of the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cover, n = [], []
            for r in range(len(batch)):
                pair = [np.concatenate([w for _, _, w, _ in word_hashes(batch.column(c).slice(r, 1))]) for c in (4, 5)]
                got = tiles(*pair, tile)
                cover.append(sum(m for _, _, m in got) / len(pair[0]))
                n.append(len(got))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cover, pa.float64()), pa.array(n, pa.int32())], names=["h1", "h2", "item_id", "times", "coverage", "n_tiles"])

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def matches(docs: DataFrame, benchmark: DataFrame, tile: int, threshold: float) -> DataFrame:
    """docs (h1, h2, text), benchmark (item_id, text) -> (h1, h2, item_id, times, coverage, n_tiles) of pairs that may reach the threshold."""
    spark = docs.sparkSession
    items = benchmark.where("text is not null").groupBy(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).agg(F.count(F.lit(1)).cast("int").alias("times"))
    items = save(items.withColumn("item", F.xxhash64("item_id", "item_text")), "items")
    seeds = save(items.select("item", "item_text").mapInArrow(_item_seeds(tile), "item long, n_words int, place int, seed long"), "seeds")
    known, side = None, seeds
    if seeds.count() <= BROADCAST_SEEDS:
        known = spark.sparkContext.broadcast(np.sort(seeds.select("seed").distinct().toPandas()["seed"].to_numpy(np.int64)))
        side = F.broadcast(seeds)
        if not len(known.value):
            return spark.createDataFrame([], "h1 long, h2 long, item_id long, times int, coverage double, n_tiles int")
    hits = docs.mapInArrow(_text_seeds(tile, known), "h1 long, h2 long, seed long")
    pairs = hits.join(side, "seed").groupBy("h1", "h2", "item", "n_words").agg(F.collect_set("place").alias("places"))  # at most an item's places
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + tile - 1)))))
    pairs = save(pairs.where(covered >= threshold * F.col("n_words")).select("h1", "h2", "item"), "seeded")
    texts = docs.join(_few(pairs.select("h1", "h2").distinct()), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("text").alias("text"))
    met = texts.join(pairs, ["h1", "h2"]).join(_few(items), "item").select("h1", "h2", "item_id", "times", "item_text", "text")
    return save(met.mapInArrow(_tiled(tile), "h1 long, h2 long, item_id long, times int, coverage double, n_tiles int"), "tiled")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", tile: int = 5, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``contaminated``, the best item's ``coverage``, ``item_id`` and ``n_tiles``, and ``n_items`` (at or over the threshold).

    A pair whose seeds alone show that its coverage is under the threshold is not tiled: where a document has no other,
    its ``coverage`` is 0 and it has no best item.
    """
    ship(docs.sparkSession)
    docs, names = hidden(without(docs, OUTPUT))
    text = names[text]
    h1, h2 = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    named = docs.where(F.col(text).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), F.col(text).alias("text"))
    pairs = matches(named, benchmark, tile, threshold)
    over = F.col("coverage") >= threshold
    best = F.max_by(F.struct("coverage", "item_id", "n_tiles"), F.struct("coverage", -F.coalesce("item_id", F.lit((1 << 63) - 1))))
    by_text = pairs.groupBy(F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(F.max(over).alias("_bad"), best.alias("_best"), F.sum(F.when(over, F.col("times")).otherwise(0)).cast("int").alias("_n"))
    joined = docs.join(_few(save(by_text, "contaminated")), (h1 == F.col("_h1")) & (h2 == F.col("_h2")) & F.col(text).isNotNull(), "left")
    made = {
        "contaminated": F.coalesce("_bad", F.lit(False)),
        "coverage": F.coalesce("_best.coverage", F.lit(0.0)),
        "item_id": F.col("_best.item_id"),
        "n_items": F.coalesce("_n", F.lit(0)),
        "n_tiles": F.coalesce("_best.n_tiles", F.lit(0)),
    }
    return revealed(joined, names, *[v.alias(k) for k, v in made.items()])
