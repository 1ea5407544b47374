"""Exact Jaccard join on word shingles with signature trees.

Texts become sets of shingle hashes; equal sets are one node from then on. The work is dealt out so that
every pair that can reach the threshold meets in at least one place, and each place is searched by a dual
traversal of signature trees: a tree's nodes hold the OR of their members' token bitmaps and the range of
their set sizes, and a pair of nodes is passed over when the largest possible overlap is too small, or when
all members are already in one component.

Dealing out is exact. Two sets within the threshold differ in at most d tokens, d from their sizes. The
token hashes of a set are cut into more than d ranges, so some ranges are the same in both, and sets that
share a range (its signature) are candidates. More ranges than needed are taken so that ranges without a
token need not count; the few sets with more empty ranges than that, and all small sets, meet by pairs of
tokens of their prefixes instead, which is exact too. Tokens that many sets hold (shared passages) would make
candidates of unlike sets, and leaving the same tokens out of all sets cannot make two sets differ in more; so
signatures are taken without them, except for sets that consist of them to a good part (groups of many near
copies), which are signed whole. Two sets within the threshold always share a way of signing. Which tokens count
as common changes the cost only, never the result. Sets are graded by size, so that d is known; a set
near the lower end of its grade also takes part in the grade below. Signatures travel packed, a few bytes
each. Candidates that hang together form a block, and a set goes to its block once.

Members of a large block are first compared with a few pivots, which settles most of a group of near
copies in time proportional to its size. Of the rest, only those meet that share enough of their tokens that are
rarest in the block (prefixes, exact as well); sets whose rarest tokens are held by more sets than a leaf has meet, in
leaves of bounded size, every leaf of such sets of the block.

Defined cases: null or empty text has an empty set and is linked with nothing; a null doc_id gets its
n_shingles and no component; rows with one doc_id belong together; repeated rows get equal results; an
empty table gives no rows; other columns are not carried, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import delete, drop, noted, save, ship
from .tokens import U, mix64, shingle_sets

SMALL = 40
GRADE = 1.5
BITS = 4096
#: Rows of a side, or tokens of its sets (32 MB), that may be broadcast; beyond it, the join is by a shuffle.
BROADCAST_IDS = 1_000_000
BROADCAST_TOKENS = 4_000_000
BROADCAST_UNITS = 500_000
PIVOTS = 8
ROUNDS = 3
#: Tokens that the prefixes of two sets must share, if their overlap has so many.
MEET = 3


@lru_cache(maxsize=None)
def grade(n: int, percent: int) -> int:
    """Lower end of the grade that holds sets of ``n`` tokens."""
    lo = SMALL
    while n >= (up := max(lo + 1, int(lo * GRADE))):
        lo = up
    return lo


@lru_cache(maxsize=None)
def ranges(lo: int, percent: int) -> tuple[int, int]:
    """Ranges of a grade, and how many may be empty.

    Of a pair in a grade below ``up``, the smaller set has under ``up`` tokens and the larger at most 100 / percent
    times as many, so they differ in at most (up - 1) * (100 - percent) / percent tokens.
    """
    up = max(lo + 1, int(lo * GRADE))
    d = floor((up - 1) * (100 - percent) / percent)
    spare = 1
    for _ in range(8):
        m = d + 1 + spare
        empty = m * exp(-0.85 * lo / m)
        spare = max(spare, min(ceil(empty + 3.5 * sqrt(empty)), d + 8))
    return d + 1 + spare, spare


@lru_cache(maxsize=None)
def _edges(m: int) -> np.ndarray:
    return np.array([((1 << 64) * i + m - 1) // m for i in range(1, m)], U)


#: A set with at least this share of tokens that are not common is signed without the common ones only.
COLD = 0.75


def least_cold(percent: int) -> float:
    """Share of tokens not common that a set has at least if it is within the threshold of one with a share of ``COLD``.

    With sizes a and b and r = a / b, the other set keeps (COLD - 1) a of them and the overlap, t / (1 + t) (a + b).
    """
    t = percent / 100
    slope = COLD - 1 + t / (1 + t)
    return slope * (t if slope > 0 else 1 / t) + t / (1 + t) - 1e-9


def signatures(tokens: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """64-bit signatures of a sorted set; two sets that reach the threshold and differ share one at least."""
    n = len(tokens)
    if n < 2:
        return np.zeros(0, U)
    found, by_pairs = [], n < SMALL or n * percent < 100 * SMALL
    if n >= SMALL:
        cold = tokens
        if len(common):
            cold = tokens[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] != tokens]
        ways = [(tokens, 1)] if len(cold) < COLD * n else []
        ways += [(cold, 2)] if len(cold) >= least_cold(percent) * n else []
        own = grade(n, percent)
        below = grade(ceil(n * percent / 100), percent) if n * percent >= 100 * SMALL else own
        for held, way in ways:
            sums = np.concatenate((np.zeros(1, U), np.cumsum(mix64(held ^ U(0xA5A5A5A5A5A5A5A5)))))
            for lo in {own, below}:
                m, spare = ranges(lo, percent)
                cut = np.concatenate(([0], np.searchsorted(held, _edges(m)), [len(held)]))
                part = sums[cut[1:]] - sums[cut[:-1]]
                full = cut[1:] > cut[:-1]
                found.append(mix64(part[full] ^ mix64(np.flatnonzero(full).astype(U) + U((m << 24) + (way << 20)))))
                by_pairs |= bool(len(full) - full.sum() > spare)
    if by_pairs:
        head = tokens[: n - ceil(n * percent / 100) + 2]
        i, j = np.triu_indices(len(head), 1)
        found.append(mix64(mix64(head[i]) * U(0x9FB21C651E98DF25) + head[j]))
    return np.concatenate(found)


def _frequent(k: int):
    """Tokens that two documents of a batch hold, with how many do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [tokens for _, tokens in shingle_sets(batch.column(0), k)]
            token, n = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["token", "n"])

    return run


def common_tokens(docs: DataFrame, k: int, least: int, most: int = 1_000_000) -> np.ndarray:
    """Sorted tokens that about ``least`` documents or more hold; the bar is raised until at most ``most`` (8 MB) are left."""
    rows = save(docs.select("text").mapInArrow(_frequent(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "frequent")
    while rows.where(F.col("n") >= least).count() > most:
        least *= 2
    got = rows.where(F.col("n") >= least).select("token").toPandas()["token"].to_numpy(np.int64)
    drop(rows)
    return np.sort(got.view(U))


def _first_pass(k: int, percent: int, buckets: int, common):
    """Batches of (doc_id, text) -> a row per document with its set's size and key, and packed signatures per bucket."""
    names = ["bucket", "doc_id", "n", "k1", "k2", "sigs", "docs"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def packed(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        bucket = (sig % U(buckets)).astype(np.int64)
        short = (mix64(sig) >> U(32)).astype(np.uint32)
        order = np.lexsort((doc, short, bucket))
        bucket, short, doc = bucket[order], short[order], doc[order]
        first = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1])))
        lead = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
        # a signature met twice here travels once; its other holders are linked to the first at once
        rows = [(-2, None, None, None, None, lead[~first].tobytes(), doc[~first].tobytes())] if not first.all() else []
        bucket, short, doc = bucket[first], short[first], doc[first]
        order = np.lexsort((doc, bucket))
        bucket, short, doc = bucket[order], short[order], doc[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, b in zip(cut[:-1], cut[1:]):
            rows.append((int(bucket[a]), None, None, None, None, short[a:b].tobytes(), np.diff(doc[a:b], prepend=0).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, doc, held = [], [], 0
        for batch in batches:
            ids, seen = batch.column(0), set()
            ns, k1, k2 = (np.zeros(len(batch), np.int64) for _ in range(3))
            for i, tokens in shingle_sets(batch.column(1), k):
                ns[i] = len(tokens)
                if not len(tokens):
                    continue
                key = int(mix64(tokens ^ U(0x0123456789ABCDEF)).sum(dtype=U)), int(np.bitwise_xor.reduce(mix64(tokens + U(0xFEDCBA987654321))))
                k1[i], k2[i] = np.array(key, U).view(np.int64)
                if key in seen or not ids[i].is_valid:
                    continue
                seen.add(key)
                s = signatures(tokens, percent, common.value)
                if len(s):
                    sig.append(s)
                    doc.append(np.full(len(s), ids[i].as_py(), np.int64))
                    held += len(s)
                if held > 2_000_000:
                    yield packed(np.concatenate(sig), np.concatenate(doc))
                    sig, doc, held = [], [], 0
            nothing = pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), -1, np.int32)), ids, *(pa.array(x) for x in (ns, k1, k2)), nothing, nothing], names=names)
        if held:
            yield packed(np.concatenate(sig), np.concatenate(doc))

    return run


def _shared(frame: pd.DataFrame) -> pd.DataFrame:
    """Packed signatures of one bucket -> a link from each holder of a signature to its least holder."""
    sig = np.concatenate([np.frombuffer(x, np.uint32) for x in frame.sigs])
    doc = np.concatenate([np.cumsum(np.frombuffer(x, np.int64)) for x in frame.docs])
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    first = np.concatenate(([True], sig[1:] != sig[:-1]))
    lead = doc[np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))]
    got = np.unique(np.stack((doc[lead != doc], lead[lead != doc]), 1), axis=0) if (lead != doc).any() else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0), batch.column(1)):
            pair = np.unique(np.stack((np.frombuffer(b.as_py(), np.int64), np.frombuffer(a.as_py(), np.int64)), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])


def candidates(first: DataFrame) -> DataFrame:
    """Links (a, b) between doc_ids that share a signature, each with the least holder only."""
    sent = first.where("bucket >= 0").select("bucket", "sigs", "docs").groupBy("bucket").applyInPandas(_shared, "a long, b long")
    near = first.where("bucket = -2").select("sigs", "docs").mapInArrow(_unpacked, "a long, b long")
    return sent.unionByName(near)


class Tree:
    """Signature tree over sorted token sets: level 0 holds the sets; each node above covers eight below."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        bits = np.zeros((len(sets), BITS // 64), U)
        size = np.array([len(sets[i]) for i in self.order], np.int64)
        for r, i in enumerate(self.order):
            at = sets[i] % U(BITS)
            np.bitwise_or.at(bits[r], (at >> U(6)).astype(np.int64), U(1) << (at & U(63)))
        # tokens that share a bit with another of their set: so many may overlap unseen by the bitmap
        self.levels = [(bits, size, size, size - np.bitwise_count(bits).sum(1).astype(np.int64))]
        while len(self.levels[-1][1]) > 1:
            bits, lo, hi, over = self.levels[-1]
            cut = np.arange(0, len(lo), self.FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, cut, axis=0), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(over, cut)))

    def below(self, level: int, i: int) -> range:
        return range(i * self.FAN, min((i + 1) * self.FAN, len(self.levels[level - 1][1])))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, groups: list[int], percent: int) -> list[tuple[int, int]]:
    """Dual traversal: pairs that reach the threshold, as many as are needed to join what they connect.

    Without ``right``, pairs within ``left``. Items are numbered left then right; ``groups`` has what is already joined.
    """
    tree, other = Tree(left), Tree(right) if right is not None else None
    items, shift = left + (right or []), len(left) if right is not None else 0
    other = other or tree
    parent = {g: g for g in groups}

    def root(i: int) -> int:
        g = groups[i]
        while parent[g] != g:
            parent[g] = g = parent[parent[g]]
        return g

    def may(p: int, i: int, q: int, j: int) -> bool:
        (b1, lo1, hi1, o1), (b2, lo2, hi2, o2) = tree.levels[p], other.levels[q]
        need = percent * (max(lo1[i], lo2[j]))  # 100 * overlap >= percent * union >= percent * either size
        need = max(need, percent * (lo1[i] + lo2[j]) * 100 // (100 + percent))
        if 100 * min(hi1[i], hi2[j]) < need:
            return False
        overlap = int(np.bitwise_count(b1[i] & b2[j]).sum()) + min(o1[i], o2[j])
        return 100 * overlap >= need

    out, work = [], [(len(tree.levels) - 1, 0, len(other.levels) - 1, 0)]
    while work:
        p, i, q, j = work.pop()
        if other is tree and p == q and i > j:
            continue
        if p == q == 0:
            a, b = tree.order[i], other.order[j] + shift
            if a == b or root(a) == root(b) or not may(0, i, 0, j):
                continue
            x, y = items[a], items[b]
            same = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * same >= percent * (len(x) + len(y) - same):
                out.append((a, b))
                parent[root(a)] = root(b)
        elif (other is tree and p == q and i == j) or may(p, i, q, j):
            work += [(p - bool(p), c, q - bool(q), e) for c in (tree.below(p, i) if p else [i]) for e in (other.below(q, j) if q else [j])]
    return out


def _searched(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "id"])
        tokens = [np.asarray(x).view(U) for x in frame.tokens]
        n = int((frame.side == 0).sum())
        ids, groups = frame.id.to_numpy(), frame.joined.tolist()
        got = linked(tokens[:n], tokens[n:] if n < len(tokens) else None, groups, percent) if n else []
        return pd.DataFrame({"a": [ids[a] for a, _ in got], "b": [ids[b] for _, b in got]}, dtype="int64")

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, values = [], [0], []
            for i, tokens in shingle_sets(batch.column(2), k):
                rows.append(i)
                values.append(tokens.view(np.int64))
                at.append(at[-1] + len(tokens))
            flat = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["id", "block", "tokens"])

    return run


def _hinted(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


def _rare_links(large: DataFrame, percent: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """``large`` (id, block, joined, tokens) -> links (a, b) by tokens that at most ``leaf`` sets of the block hold, and the ids of sets with others in their prefix.

    Tokens go from the rarest in the block on. Where two sets overlap in o tokens, the first ``MEET`` common ones (or all
    o) lie within the first n - o + ``MEET`` of either set. A pair with only one or no set of the second kind shares
    ``MEET`` tokens of the first kind there; what lies behind the last of these bounds the rest of its overlap.
    """
    rows = large.select("id", "block", "joined", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rows = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("block", "token"))).where("c > 1")
    held = rows.groupBy("id", "block", "joined", "n").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("r"))
    # tokens that no other set holds come first and are only counted
    length = f"cast(greatest(0, least(n, n - ({percent} * n + 99) div 100 + {MEET}) - (n - size(r))) as int)"
    held = save(held.select("id", "block", "joined", "n", F.expr("n - size(r)").alias("alone"), F.expr(f"slice(r, 1, {length})").alias("r")), "prefixes")
    places = held.select("id", "block", "joined", "n", "alone", F.posexplode("r").alias("i", "p")).select("id", "block", "joined", "n", (F.col("alone") + F.col("i")).alias("at"), "p.c", "p.token")
    often = save(places.where(F.col("c") > leaf).select("id").distinct(), "often")
    rare = places.where(F.col("c") <= leaf)
    one, two = (rare.select("block", "token", F.col("id").alias(x), F.col("joined").alias(f"j{x}"), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}")) for x in "ab")
    met = one.join(two, ["block", "token"]).where(f"a < b and ja <> jb and 100 * least(na, nb) >= {percent} * greatest(na, nb)")
    met = met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("s"), F.max("ata").alias("ata"), F.max("atb").alias("atb"))
    met = met.where(f"s >= least({MEET}, ({percent} * greatest(na, nb) + 99) div 100) and {100 + percent} * (s + least(na - ata, nb - atb) - 1) >= {percent} * (na + nb)")
    sets = large.select("id", "tokens")
    both = save(met.select("a", "b"), "near").join(sets.withColumnsRenamed({"id": "a", "tokens": "ta"}), "a").join(sets.withColumnsRenamed({"id": "b", "tokens": "tb"}), "b")
    both = both.withColumn("same", F.size(F.array_intersect("ta", "tb"))).where(100 * F.col("same") >= percent * (F.size("ta") + F.size("tb") - F.col("same")))
    return save(both.select("a", "b"), "links"), often


def links(members: DataFrame, percent: int, leaf: int) -> DataFrame:
    """``members`` (id, block, tokens), a written table -> links (a, b) between ids that connect all that the threshold connects."""
    sizes = save(members.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where(f"size > {leaf}"), "large")
    edges = None
    joined = None  # (id, joined): what pivots have connected so far in large blocks
    if sizes.limit(1).count():
        large = members.join(_hinted(sizes.select("block"), BROADCAST_IDS), "block")
        members_large, before = large.count(), 0
        for turn in range(ROUNDS):
            free = large if joined is None else large.join(_hinted(joined.select("id"), BROADCAST_IDS), "id", "left_anti")
            choice = free.groupBy("block", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(PIVOTS)).alias("_")).agg(F.min("id").alias("id"))
            choice = save(choice.select("block", "id"), "choice")
            if not choice.limit(1).count():
                break
            pivots = save(large.join(_hinted(choice.select("id"), BROADCAST_IDS), "id").select("block", F.col("id").alias("pivot"), F.col("tokens").alias("held")), "pivots")
            held = pivots.agg(F.sum(F.size("held") + 4)).first()[0] or 0  # 8 bytes a token, and some for a row
            met = large.join(F.broadcast(pivots) if held <= BROADCAST_TOKENS else pivots, "block").where(F.col("id") != F.col("pivot"))
            same = F.size(F.array_intersect("tokens", "held"))
            met = met.withColumn("same", same).where(100 * F.col("same") >= percent * (F.size("tokens") + F.size("held") - F.col("same")))
            found = save(met.select(F.col("id").alias("a"), F.col("pivot").alias("b")), "links")
            edges = found if edges is None else edges.unionByName(found)
            joined = save(components(edges).select(F.col("node").alias("id"), F.col("component").alias("joined")), "joined")
            before, now = joined.count(), before
            if 10 * (before - now) < members_large:  # few were settled: leave the rest to the trees
                break
    # leaves: of a large block by the largest component in it (settled among themselves) and the others
    if joined is None:
        units = members.select("id", F.col("id").alias("joined"), F.lit(0).alias("side"), "tokens", F.col("block").alias("u1"), F.lit(0).alias("u2"), F.lit(0).alias("u3"))
    else:
        known = members.select("id", "block", F.size("tokens").alias("n")).join(_hinted(sizes, BROADCAST_IDS), "block", "left").join(_hinted(joined, BROADCAST_IDS), "id", "left")
        known = known.withColumn("joined", F.coalesce("joined", "id"))
        main = known.where("size is not null").groupBy("block", "joined").agg(F.count(F.lit(1)).alias("c")).groupBy("block").agg(F.max(F.struct("c", F.col("joined"))).alias("m"))
        main = save(main.select("block", F.col("m.joined").alias("main")), "main")
        rare, often = _rare_links(large.join(_hinted(joined, BROADCAST_IDS), "id", "left").withColumn("joined", F.coalesce("joined", "id")), percent, leaf)
        edges = edges.unionByName(rare)
        known = known.where("size is null").unionByName(known.where("size is not null").join(_hinted(often, BROADCAST_IDS), "id", "left_semi"))
        known = known.join(_hinted(main, BROADCAST_IDS), "block", "left").withColumn("settled", F.coalesce(F.col("joined") == F.col("main"), F.lit(False)))
        # leaves in the order of size, by counts per size; a leaf is known by twice its number, plus one if settled
        per_size = known.groupBy("block", "settled", "n").agg(F.count(F.lit(1)).alias("c"))
        along = Window.partitionBy("block", "settled").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        per_size = save(per_size.withColumn("before", F.coalesce(F.sum("c").over(along), F.lit(0))), "per-size")
        at = F.floor((F.col("before") + F.pmod(F.xxhash64("id", F.lit(99)), F.col("c"))) / leaf) * 2 + F.col("settled").cast("int")
        known = save(known.join(_hinted(per_size, BROADCAST_IDS), ["block", "settled", "n"]).select("id", "block", "joined", "n", at.cast("long").alias("leaf")), "known")
        leaves = save(known.groupBy("block", "leaf").agg(F.min("n").alias("lo"), F.max("n").alias("hi")), "leaves")
        free = leaves.where("leaf % 2 = 0").select("block", F.col("leaf").alias("u2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        # pairs of leaves whose sizes can reach the threshold: free with free (each once), and free with settled
        pairs = free.join(leaves.withColumnRenamed("leaf", "u3"), "block").where("u3 % 2 = 1 or u2 <= u3").where(100 * F.least("hi", "hi2") >= percent * F.greatest("lo", "lo2"))
        pairs = save(pairs.select("block", "u2", "u3"), "pairs")
        roles = pairs.select("block", F.col("u2").alias("leaf"), "u2", "u3", F.lit(0).alias("side")).unionByName(pairs.where("u2 <> u3").select("block", F.col("u3").alias("leaf"), "u2", "u3", F.lit(1).alias("side")))
        units = known.join(roles, ["block", "leaf"]).select("id", "joined", "side", F.col("block").alias("u1"), "u2", "u3")
        # token sets are shuffled once, to their leaves
        units = members.select("id", "tokens").join(_hinted(save(units, "units"), BROADCAST_UNITS), "id").select("id", "joined", "side", "tokens", "u1", "u2", "u3")
    searched = units.groupBy("u1", "u2", "u3").applyInPandas(_searched(percent), "a long, b long")
    return searched if edges is None else edges.unionByName(searched)


def jaccard_components(docs: DataFrame, text: str = "text", k: int = 5, percent: int = 80, leaf: int = 128, bucket_signatures: int = 400_000, common_from: int = 16) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents linked where 100 * overlap >= percent * union of their ``k``-word shingles."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    spark = docs.sparkSession
    ship(spark)
    with noted() as made:
        out = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), k, percent, leaf, bucket_signatures, common_from)
        out = save(out, "components")
    delete(spark, made[:-1])
    return out


def _components(docs: DataFrame, k: int, percent: int, leaf: int, bucket_signatures: int, common_from: int) -> DataFrame:
    """The result from tables that may be deleted once it is written."""
    per_set = docs.agg(F.count(F.lit(1)), F.avg(F.length("text"))).first()
    expected = per_set[0] * max(8.0, (per_set[1] or 0) / 6 * (100 - percent) / 50)
    buckets = 64 * max(1, round(expected / bucket_signatures / 64))
    types = "bucket int, doc_id long, n long, k1 long, k2 long, sigs binary, docs binary"
    common = docs.sparkSession.sparkContext.broadcast(common_tokens(docs, k, common_from))
    first = save(docs.mapInArrow(_first_pass(k, percent, buckets, common), types), "sets")
    narrow = save(first.where("bucket = -1").select("doc_id", "n", "k1", "k2"), "narrow")
    classes = save(narrow.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # candidates between documents, then between the least documents of equal sets
    found = save(candidates(first).distinct(), "candidates")
    drop(first)
    ids = found.select(F.col("a").alias("doc_id")).unionByName(found.select(F.col("b").alias("doc_id"))).distinct()
    reps = save(narrow.join(_hinted(save(ids, "ids"), BROADCAST_IDS), "doc_id").where("n > 0").join(classes, ["k1", "k2", "n"]).select("doc_id", "rep").distinct(), "reps")
    by_rep = found.join(reps.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    block = save(components(by_rep.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "blocks")
    # each candidate's set goes to its block once
    near = docs.join(_hinted(block.select(F.col("node").alias("doc_id"), F.col("component").alias("block")), BROADCAST_IDS), "doc_id")
    members = save(near.select("doc_id", "block", "text").mapInArrow(_sets(k), "id long, block long, tokens array<long>").where("size(tokens) > 0"), "members")
    for used in (found, reps, block):
        drop(used)
    linked_to = save(links(members, percent, leaf), "links")
    drop(members)
    joined = components(linked_to)
    joined = joined.select(F.col("node").alias("rep"), "component")
    classes = classes.join(joined, "rep", "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = narrow.join(classes.withColumnsRenamed({"k1": "c1", "k2": "c2", "n": "cn"}), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("cn")), "left")
    mine = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), mine.alias("component_id"))


def _sql(k: int, percent: int) -> str:
    """The components in SQL, by all pairs of documents that share a shingle; equal sets are one node."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(list_slice(w, i, i + {k - 1}), ' ')))) END AS sh FROM d),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT rep, n, unnest(sh) AS g FROM c),
p AS (SELECT a.rep AS x, b.rep AS y FROM t a JOIN t b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node WHERE r.root < e.y),
q AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(q.root, doc_id) AS component_id FROM s LEFT JOIN c USING (sh) LEFT JOIN q ON q.node = c.rep"""


ORACLE_SQL = _sql(3, 90)
