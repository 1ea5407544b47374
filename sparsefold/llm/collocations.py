"""Phrases of two to four words that stand together more often than their parts let expect, per language.

1. A survey of the texts counts words exactly and pairs and triples of words by hash in sketches of a fixed size: a pair
whose slot stays under the bar is no part of a phrase; one whose slot is very full is hot. 2. Tasks cut suffixes of up to
four words where a pair is infrequent, combine equal ones, and deal them out by their two leading words; those of a hot
pair by three words, of a hot triple by four, with one row for the shorter phrase beside them. 3. In each bucket a
multikey three-way quicksort of suffix pointers runs to depth four: the weight of an equal part is the phrase's count,
parts under the bar are abandoned. 4. Joins of the phrases with their own parts give the scores.

Words are known by 64-bit hashes of language and word until the end, so counts are exact up to their collisions; the
sketches only say what cannot be frequent and how rows travel.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count again; phrases do not cross pieces,
rows or languages; ties go by count, then by the phrase's bytes; an empty table gives no rows; texts and words of any
length are read whole; other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import save, ship
from .tokens import LOWER, U, chunks, mix64, span_hashes, word_spans

#: Bytes that end a piece, and those that stand between words.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
INSIDE = ~ENDS
INSIDE[[0x20, 0x09]] = False
DEPTH = 4
CHUNK = 1 << 20
#: Slots of a sketch travel in blocks of so many.
BLOCK = 1 << 16
FAN_IN = 64
SURVEY = ["kind", "key", "lang", "word", "n", "part", "slots", "counts"]
_SPREAD = U(0x9FB21C651E98DF25)


@cache
def _lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _words(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(lang, text) -> by chunk: bytes, starts, ends and rows of words, their keys, and whether the next word is in the same piece."""
    langs = ["und" if x is None else x for x in batch.column(0).to_pylist()]
    by_row = np.array([_lang_key(x) for x in langs], U)
    for first, end, data, offsets in chunks(batch.column(1), CHUNK):
        data = LOWER[data]
        starts, ends, row = word_spans(data, offsets, INSIDE)
        keys = mix64(span_hashes(data, starts, ends) ^ by_row[first + row])
        keys[keys == 0] = 1
        piece = np.concatenate(([0], np.cumsum(ENDS[data])))[starts]
        joined = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        yield langs, first, data, starts, ends, row, keys, np.append(joined, False)[: len(keys)]


def _ahead(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` from its ``n``-th value, filled up with zeros."""
    return np.concatenate((x[n:], np.zeros(min(n, len(x)), x.dtype)))


def _runs(keys: np.ndarray) -> list[np.ndarray]:
    """Hashes of the runs of 2, 3 and 4 words that begin at each."""
    out = [keys]
    for n in range(1, DEPTH):
        out.append(mix64(out[-1] * _SPREAD + _ahead(keys, n)))
    return out[1:]


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64)


class _Tally:
    """Counts of a task's words; chunks are merged, and given out when they hold too many words."""

    def __init__(self, most: int = 200_000):
        self.most, self.parts, self.held = most, [], 0

    def add(self, key: np.ndarray, n: np.ndarray, lang: pa.Array, word: pa.Array) -> pa.RecordBatch | None:
        self.parts.append((key, n, lang, word))
        self.held += len(key)
        if self.held > self.most:
            self._merge()
            if self.held > self.most // 2:
                return self.rows()
        return None

    def _merge(self) -> None:
        key, n = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        own, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        lang, word = (pa.concat_arrays([p[i] for p in self.parts]).take(pa.array(at)) for i in (2, 3))
        self.parts, self.held = [(own, np.bincount(inverse, n, len(own)).astype(np.int64), lang, word)], len(own)

    def rows(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        self._merge()
        (key, n, lang, word), self.parts, self.held = self.parts[0], [], 0
        none = pa.nulls(len(key), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int32)), pa.array(key.view(np.int64)), lang, word, pa.array(n), pa.nulls(len(key), pa.int32()), none, none], names=SURVEY)


def _spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of bytes as an Arrow column of strings."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    own = data[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own.tobytes()))


def _surveyed(bits: dict[int, int]):
    """(lang, text) -> counts of words (kind 0), and the task's sketches of pairs and triples in blocks (kinds 2, 3)."""
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, tally = {k: np.zeros(1 << b, np.uint32) for k, b in bits.items()}, _Tally()
        for batch in batches:
            for langs, first, data, starts, ends, row, keys, joined in _words(batch):
                key, at, n = np.unique(keys, return_index=True, return_counts=True)
                if (rows := tally.add(key, n, pa.array(langs, pa.string()).take(pa.array(first + row[at])), _spelt(data, starts[at], ends[at]))) is not None:
                    yield rows
                pair, triple, _ = _runs(keys)
                for k, h, whole in ((2, pair, joined), (3, triple, joined & _ahead(joined, 1))):
                    slot, n = np.unique(_slots(h[whole], bits[k]), return_counts=True)
                    sketches[k][slot] += n.astype(np.uint32)
        if (rows := tally.rows()) is not None:
            yield rows
        rows = []
        for k, sketch in sketches.items():
            held = np.flatnonzero(sketch)
            for block in np.unique(held // BLOCK):
                own = held[np.searchsorted(held, block * BLOCK) : np.searchsorted(held, (block + 1) * BLOCK)]
                rows.append((k, int(block), None, None, None, TaskContext.get().partitionId(), (own % BLOCK).astype(np.uint16).tobytes(), sketch[own].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=SURVEY)

    return run


def _added(key: tuple, rows: pa.Table) -> pa.Table:
    """Blocks of sketches of several tasks as one."""
    total = np.zeros(BLOCK, np.int64)
    for slots, counts in zip(rows["slots"].to_pylist(), rows["counts"].to_pylist()):
        total[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.uint32)
    held = np.flatnonzero(total)
    kind, block, part = (int(k.as_py()) for k in key)
    counts = np.minimum(total[held], 0xFFFFFFFF).astype(np.uint32)
    columns = [[kind], [block], [part], [held.astype(np.uint16).tobytes()], [counts.tobytes()]]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "key", "part", "slots", "counts"])


def _bitmaps(survey: DataFrame, bits: dict, bars: dict[str, tuple[int, float]]) -> dict[str, np.ndarray]:
    """For each (kind, bar), a bit for each slot that reaches it; the driver gets a number of bytes that is fixed."""
    blocks = survey.where("kind > 0").select("kind", "key", "part", "slots", "counts")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = max(1, parts // FAN_IN)
        blocks = blocks.withColumn("part", F.col("part") % parts).groupBy("kind", "key", "part").applyInArrow(_added, "kind int, key long, part int, slots binary, counts binary")
        if parts == 1:
            break

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for kind, block, slots, counts in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
                slots, counts = np.frombuffer(slots, np.uint16), np.frombuffer(counts, np.uint32)
                for name, (k, bar) in bars.items():
                    if k == kind and (counts >= bar).any():
                        full = np.zeros(BLOCK, bool)
                        full[slots[counts >= bar]] = True
                        rows.append((name, block, np.packbits(full).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["name", "block", "bits"])

    out = {name: np.zeros((1 << bits[k]) // 8, np.uint8) for name, (k, _) in bars.items()}
    for r in blocks.mapInArrow(packed, "name string, block long, bits binary").collect():
        at = r.block * BLOCK // 8
        size = min(BLOCK // 8, len(out[r["name"]]) - at)
        out[r["name"]][at : at + size] = np.frombuffer(r.bits, np.uint8)[:size]
    return out


def _cut_suffixes(buckets: int, bits: dict, maps: dict[str, np.ndarray]):
    """(lang, text) -> combined suffixes by bucket: keys of their words (0: none), weights, and the depth from which they count."""
    names = ["bucket", *[f"k{i}" for i in range(DEPTH)], "weight", "since"]
    full = lambda name, k, h: (maps[name][(s := _slots(h, bits[k])) >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, keys, joined in _words(batch):
                runs = _runs(keys)
                live = joined & full("frequent", 2, runs[0])
                depth, on = np.ones(len(keys), np.int64), np.ones(len(keys), bool)
                for n in range(DEPTH - 1):
                    on = on & _ahead(live, n)
                    depth += on
                at = np.flatnonzero(depth > 1)
                if not len(at):
                    continue
                depth = depth[at]
                pair, triple, four = (r[at] for r in runs)
                k = np.stack([np.where(depth > n, _ahead(keys, n)[at], U(0)) for n in range(DEPTH)])
                whole = np.choose(depth - 2, (pair, triple, four)) + depth.astype(U)
                _, first, weight = np.unique(whole, return_index=True, return_counts=True)
                depth, pair, triple, four, k = depth[first], pair[first], triple[first], four[first], k[:, first]
                by_three = (depth > 2) & full("hot_pairs", 2, pair)
                by_four = by_three & (depth > 3) & full("hot_triples", 3, triple)
                since = (2 + by_three + by_four).astype(np.uint8)
                parts = [(np.choose(since - 2, (pair, triple, four)), k, weight, since)]
                for n, routed, route in ((2, by_three, pair), (3, by_four, triple)):  # a row for the shorter phrase
                    i = np.flatnonzero(routed)
                    own, j, inverse = np.unique(route[i], return_index=True, return_inverse=True)
                    short = k[:, i[j]].copy()
                    short[n:] = 0
                    parts.append((own, short, np.bincount(inverse, weight[i], len(own)).astype(np.int64), np.full(len(own), n, np.uint8)))
                route, weight, since = (np.concatenate([p[c] for p in parts]) for c in (0, 2, 3))
                k = np.concatenate([p[1] for p in parts], 1)
                bucket = (mix64(route) % U(buckets)).astype(np.int32)
                order = np.lexsort((route, bucket))
                bucket, weight, since, k = bucket[order], weight[order].astype(np.uint32), since[order], k[:, order]
                edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                sliced = [[c[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])] for c in (*k, weight, since)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), *(pa.array(c, pa.binary()) for c in sliced)], names=names)

    return run


def multikey_quicksort(keys: list[np.ndarray], weight: np.ndarray, since: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, length, count) of every phrase of two words or more that reaches ``least``; ``row`` begins with it.

    Pointers to rows are split in three by a pivot at one depth; the equal part goes on at the next. A part that
    weighs less than ``least`` holds no such phrase.
    """
    rows, out = np.arange(len(weight)), []
    stack = [(0, len(rows), 0)]
    while stack:
        low, high, depth = stack.pop()
        own = rows[low:high]
        value = keys[depth][own]
        pivot = np.partition(value[[0, len(value) // 2, -1]], 1)[1]
        less, equal = value < pivot, value == pivot
        split = own[less], own[equal], own[~(less | equal)]
        if len(split[1]) < len(own):
            rows[low:high] = np.concatenate(split)
        a, b = low + len(split[0]), low + len(split[0]) + len(split[1])
        if a > low and weight[split[0]].sum() >= least:
            stack.append((low, a, depth))
        if b < high and weight[split[2]].sum() >= least:
            stack.append((b, high, depth))
        if pivot and weight[split[1]].sum() >= least:
            if depth:
                counts = split[1][since[split[1]] <= depth + 1]
                if (n := int(weight[counts].sum())) >= least:
                    out.append((int(split[1][0]), depth + 1, n))
            if depth + 1 < len(keys):
                stack.append((a, b, depth + 1))
    return out


def _mined(least: int):
    """The suffixes of one bucket -> phrases as arrays of keys, with their counts."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [np.concatenate([np.frombuffer(x, U) for x in rows[f"k{i}"].to_pylist()]) for i in range(DEPTH)]
        weight = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["weight"].to_pylist()]).astype(np.int64)
        since = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["since"].to_pylist()])
        got = multikey_quicksort(keys, weight, since, least)
        phrases = [[int(keys[i].view(np.int64)[row]) for i in range(n)] for row, n, _ in got]
        return pa.table([pa.array(phrases, pa.list_(pa.int64())), pa.array([n for *_, n in got], pa.int64())], names=["p", "a"])

    return run


def _parts(p: F.Column, pairs: list[tuple[int, int]]) -> list[F.Column]:
    return [F.slice(p, start, length) for start, length in pairs]


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000, pair_bits: int = 23, triple_bits: int = 20, bucket_words: int = 1_500_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language.

    A bucket holds the suffixes of about ``bucket_words`` words; a pair or triple with a quarter of that is hot.
    """
    ship(docs.sparkSession)
    texts, bits = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")), {2: pair_bits, 3: triple_bits}
    survey = save(texts.mapInArrow(_surveyed(bits), "kind int, key long, lang string, word string, n long, part int, slots binary, counts binary"), "survey")
    words = save(survey.where("kind = 0").groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    n = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(32, n // bucket_words)
    hot = max(least, n / buckets / 4)
    maps = _bitmaps(survey, bits, {"frequent": (2, least), "hot_pairs": (2, hot), "hot_triples": (3, hot)})
    suffixes = texts.mapInArrow(_cut_suffixes(buckets, bits, maps), "bucket int, k0 binary, k1 binary, k2 binary, k3 binary, weight binary, since binary")
    phrases = save(suffixes.groupBy("bucket").applyInArrow(_mined(least), "p array<long>, a long"), "phrases")
    # candidates inside a longer one that is nearly as frequent go
    p = F.col("p")
    inner = F.when(F.size(p) == 3, F.array(*_parts(p, [(1, 2), (2, 2)]))).otherwise(F.array(*_parts(p, [(1, 2), (2, 2), (3, 2), (1, 3), (2, 3)])))
    longer = phrases.where(F.size(p) > 2).select(F.explode(inner).alias("p"), F.col("a").alias("longer")).groupBy("p").agg(F.max("longer").alias("longer"))
    kept = phrases.join(longer, "p", "left").where("longer is null or 100 * longer < 80 * a").drop("longer")
    # the counts of both sides of each cut
    counts = phrases.select(p.alias("q"), F.col("a").alias("f")).unionByName(words.where(F.col("f") >= least).select(F.array("key").alias("q"), "f"))
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.size(p) - 1)))
    side = F.array(F.struct(F.lit(True).alias("left"), F.slice(p, F.lit(1), F.col("cut")).alias("q")), F.struct(F.lit(False).alias("left"), F.slice(p, F.col("cut") + 1, F.size(p) - F.col("cut")).alias("q")))
    sides = cuts.select("p", "a", "cut", F.explode(side).alias("s")).select("p", "a", "cut", "s.left", "s.q").join(counts, "q")
    both = sides.groupBy("p", "a", "cut").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)")
    lowest = both.withColumn("score", score).groupBy("p", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m")).select("p", "a", "m.l", "m.r", "m.score")
    # words for keys, and the first of each language
    named = lowest.select("*", F.posexplode("p").alias("at", "key")).join(words.select("key", "lang", "word"), "key")
    spelt = named.groupBy("p", "a", "l", "r", "score").agg(F.max("lang").alias("lang"), *[F.max(F.when(F.col("at") == i, F.col("word"))).alias(f"w{i}") for i in range(DEPTH)])
    spelt = spelt.withColumn("phrase", F.concat_ws(" ", *[f"w{i}" for i in range(DEPTH)]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, rid, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS t FROM d),
e AS (SELECT lang, rid, piece, regexp_extract_all(t, '[^\\x20\\x09]+') AS ws FROM p),
o AS (SELECT lang, rid, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM e),
x AS (SELECT lang, w, lead(w) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4 FROM o WINDOW s AS (PARTITION BY rid, piece ORDER BY i)),
g AS (SELECT lang, [w] AS p FROM x UNION ALL SELECT lang, [w, w2] FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, [w, w2, w3] FROM x WHERE w3 IS NOT NULL UNION ALL SELECT lang, [w, w2, w3, w4] FROM x WHERE w4 IS NOT NULL),
f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY lang, p HAVING count(*) >= 30),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
inner_runs AS (SELECT lang, a, unnest(CASE WHEN len(p) = 3 THEN [p[1:2], p[2:3]] ELSE [p[1:2], p[2:3], p[3:4], p[1:3], p[2:4]] END) AS p FROM c WHERE len(p) > 2),
m AS (SELECT lang, p, max(a) AS longer FROM inner_runs GROUP BY lang, p),
kept AS (SELECT lang, p, a FROM c LEFT JOIN m USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (SELECT u.lang, u.p, a, k, l.f AS l, r.f AS r, (CAST(a AS HUGEINT) * 2000000) // (l.f + r.f) AS score FROM cuts u JOIN f l ON l.lang = u.lang AND l.p = u.p[1:k] JOIN f r ON r.lang = u.lang AND r.p = u.p[k + 1:]),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM scored),
named AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM lowest WHERE o = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
