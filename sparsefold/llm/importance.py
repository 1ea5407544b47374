"""Importance resampling towards a target: hashed n-gram weights, Gumbel keys, and a distributed quickselect of the best.

1. Tasks hash all runs of 1 to 3 words of their texts into buckets and sum the counts of each bucket, for documents and
   for the target; the sums are one row per bucket. 2. The array of gains by bucket scores each document. 3. Of the
   scored rows, written once, the k-th best composite key (score descending, doc_id, row) is found by rounds of random
   pivots: one aggregate counts the rows before, at and after each pivot, and the interval that holds the k-th stays.
   4. Rows up to that key alone are sorted and ranked.

A run's bucket is the CRC-32 of its bytes; as CRC-32 is linear, that of a run comes from those of its words.

Defined cases: null or blank text has no words, weight 0, and is not drawn; a null doc_id is keyed as the empty string
and comes last among equal scores; rows that repeat a doc_id are documents of their own, equal ones are told apart by
their place; texts of any length are hashed whole; an empty table gives no rows, an empty target draws by the other
documents' rarity alone; other columns are not carried.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import save, ship
from .tokens import ALNUM_BYTES, LOWER, chunks, word_spans

#: Shifts of CRC-32 by up to so many bytes are kept as tables.
STEP = 64
LAST = (1 << 63) - 1
RESULT = ["doc_id", "n_features", "weight", "score", "rank"]


@cache
def _shifts() -> np.ndarray:
    """[n, j, b]: the remainder of byte b at place j followed by n zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1)
    out = np.empty((STEP + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(STEP):
        out[n + 1] = byte[out[n] & 255] ^ (out[n] >> 8)
    return out


def _shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Remainders followed by ``n`` zero bytes each."""
    table = _shifts()
    while len(far := np.flatnonzero(n > STEP)):
        crc, n = crc.copy(), n.copy()
        crc[far] = _shifted(crc[far], np.full(len(far), STEP))
        n[far] -= STEP
    return table[n, 0, crc & 255] ^ table[n, 1, (crc >> 8) & 255] ^ table[n, 2, (crc >> 16) & 255] ^ table[n, 3, crc >> 24]


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    size, at = size[order], starts[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    step = _shifts()[1, 0]
    long = int(np.searchsorted(-size, -STEP))
    for i in range(int(size[long]) if long < len(size) else 0):
        on = slice(long, int(np.searchsorted(-size, -i)))  # spans with a byte i
        crc[on] = step[(crc[on] ^ data[at[on] + i]) & 255] ^ (crc[on] >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(long):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def feature_buckets(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Row of each word, and for runs of 1 to ``most`` words the row and bucket of each."""
    data = LOWER[data]
    starts, ends, row = word_spans(data, offsets, ALNUM_BYTES)
    word, size, blank = crc32s(data, starts, ends), ends - starts, np.uint32(zlib.crc32(b" "))
    run, out = word, [(row, (word % np.uint32(buckets)).astype(np.int64))]
    for k in range(1, most):
        run = _shifted(run[: max(0, len(row) - k)], np.ones(max(0, len(row) - k), np.int64)) ^ blank
        run = _shifted(run, size[k:]) ^ word[k:]
        whole = row[: max(0, len(row) - k)] == row[k:]
        out.append((row[k:][whole], (run[whole] % np.uint32(buckets)).astype(np.int64)))
    return row, out


def _counted(most: int, buckets: int):
    """Texts -> (bucket, n) of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                for _, at in feature_buckets(data, offsets, most, buckets)[1]:
                    n += np.bincount(at, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["bucket", "n"])

    return run


def _scored(most: int, gains: np.ndarray):
    """(doc_id, text) -> counts of words and features, and the sum of gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
            for first, end, data, offsets in chunks(batch.column(1)):
                row, runs = feature_buckets(data, offsets, most, len(gains))
                words[first:end] = np.bincount(row, minlength=end - first)
                for row, at in runs:
                    edge = np.searchsorted(row, np.arange(end - first + 1))
                    features[first:end] += np.diff(edge)
                    weight[first:end] += np.diff(np.concatenate(([0], np.cumsum(gains[at])))[edge])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def _counts(texts: DataFrame, most: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; the driver gets one row per bucket."""
    got = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(_counted(most, buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        got[r.bucket] = r.n
    return got


def gains_of(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's smoothed share of a bucket to that of the documents."""
    size, all_s, all_t = len(s), float(s.sum()), float(t.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (all_s + size) / ((float(a) + 1) * (all_t + size)))) for a, b in zip(s, t)], np.int64)


def _before(p) -> F.Column:
    """Whether a row's key comes before the key (score, order, row) ``p``."""
    score, order, row = (F.col(c) for c in ("score", "_order", "_row"))
    return (score > p[0]) | ((score == p[0]) & ((order < p[1]) | ((order == p[1]) & (row < p[2]))))


def kth_key(rows: DataFrame, k: int, seed: int = 0, pivots: int = 31) -> tuple[int, int, int]:
    """The ``k``-th key (from 1) of rows with unique keys (score descending, _order, _row), by rounds of random pivots."""
    inside, turn = rows.select("score", "_order", "_row"), 0
    low = high = None
    while True:
        turn += 1
        live = inside
        if low is not None:
            live = live.where(~_before(low) & (F.col("score") <= low[0]) & (F.col("_row") != low[2]))
        if high is not None:
            live = live.where(_before(high) & (F.col("score") >= high[0]))
        drawn = live.orderBy(F.xxhash64("_row", F.lit(seed + turn)), "_row").limit(pivots).collect()
        drawn = sorted(((r.score, r._order, r._row) for r in drawn), key=lambda p: (-p[0], p[1], p[2]))
        n = live.agg(*[F.count(F.when(_before(p), 1)).alias(f"n{i}") for i, p in enumerate(drawn)]).first()
        passed, bounds = 0, (low, high)
        for p, before in zip(drawn, n):
            if before + 1 == k:
                return p
            if before >= k:
                bounds = bounds[0], p
                break
            passed, bounds = before + 1, (p, high)
        low, high = bounds
        k -= passed


def resample(docs: DataFrame, target: DataFrame, text: str = "text", most: int = 3, buckets: int = 10_000, seed: int = 42, least_words: int = 20, percent: int = 5) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; those drawn have a rank.

    Of the documents with ``least_words`` words, ``percent`` in a hundred are drawn (rounded down).
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    gains = gains_of(_counts(texts.select("text"), most, buckets), _counts(target.select(F.col(f"`{text}`")), most, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = texts.mapInArrow(_scored(most, gains), "doc_id long, n_words long, n_features long, weight long")
    scored = scored.withColumns({"score": F.col("weight") + noise, "_order": F.coalesce("doc_id", F.lit(LAST)), "_row": F.monotonically_increasing_id()})
    scored = save(scored, "scored")
    able = scored.where(F.col("n_words") >= least_words)
    k = able.count() * percent // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*RESULT[:-1], unranked)
    last = kth_key(able, k, seed)
    wins = (F.col("n_words") >= least_words) & (_before(last) | (F.col("_row") == last[2]))
    best = save(scored.where(wins).orderBy(F.desc("score"), "_order", "_row").withColumn("_at", F.monotonically_increasing_id()), "drawn")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    held = best.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))  # a row per range of keys
    first = held.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_first"))
    ranked = best.withColumn("_part", part).join(F.broadcast(first), "_part").select(*RESULT[:-1], (F.col("_first") + place + 1).alias("rank"))
    return ranked.unionByName(scored.where(~wins).select(*RESULT[:-1], unranked))


ORACLE_SQL = """
WITH every AS (SELECT 0 AS side, doc_id, text, row_number() OVER () AS rid FROM documents UNION ALL SELECT 1, NULL, text, -row_number() OVER () FROM benchmark),
lowered AS (SELECT side, doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM every),
placed AS (SELECT side, rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM lowered),
next AS (SELECT side, rid, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM placed WINDOW p AS (PARTITION BY rid ORDER BY i)),
runs AS (SELECT side, rid, w AS f FROM next UNION ALL SELECT side, rid, w || ' ' || w2 FROM next WHERE w2 IS NOT NULL UNION ALL SELECT side, rid, w || ' ' || w2 || ' ' || w3 FROM next WHERE w3 IS NOT NULL),
counted AS (SELECT side, rid, f, count(*) AS n FROM runs GROUP BY ALL),
bits AS (SELECT f, list_transform(string_split(CAST(CAST(encode(f) AS BIT) AS VARCHAR), ''), lambda x: CAST(x AS BIGINT)) AS b FROM (SELECT DISTINCT f FROM counted)),
ordered AS (SELECT f, list_select(b, list_transform(range(0, len(b)), lambda i: (i // 8) * 8 + 8 - i % 8)) AS b FROM bits),
crc AS (SELECT f, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) % 10000 AS bucket FROM ordered),
held AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM counted JOIN crc USING (f) GROUP BY bucket),
total AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS all_s, CAST(coalesce(sum(t), 0) AS DOUBLE) AS all_t FROM held),
gain AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(s AS DOUBLE) + 1) * (all_t + 10000)))) AS BIGINT) AS g FROM held, total),
weighed AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight FROM counted JOIN crc USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY rid),
scored AS (SELECT doc_id, rid, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM lowered LEFT JOIN weighed USING (rid) WHERE side = 0),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN r <= 5 * able // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (rid)"""
