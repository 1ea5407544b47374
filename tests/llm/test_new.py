"""Collocations, byte pairs and importance resampling against brute force, by-hand cases and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparsefold.llm import byte_pairs, collocations, importance, tokens
from sparsefold.llm.store import LOWER, UPPER

tiktoken = pytest.importorskip("tiktoken")
vocabularies = pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
PATH = vocabularies.path("byte_bpe_multi_50k.tiktoken")
TABLE = str.maketrans(UPPER, LOWER)
DOCS = "doc_id long, text string, lang string, rank string, score string, a string, _row string, bucket string"


def made(spark, rows):
    """Documents with columns that operators use themselves."""
    return spark.createDataFrame([(i, t, lang, *["x"] * 5) for i, t, lang in rows], DOCS)


# --- collocations


def brute_phrases(docs, least=30, top=2000):
    count, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(TABLE)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                count.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in count.items() if a >= least and len(p) > 2}
    longer = defaultdict(int)
    for (lang, *w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, *w[i : i + k]] = max(longer[lang, *w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, *w), a in found.items():
        if 100 * longer[lang, *w] >= 80 * a:
            continue
        cuts = [(2_000_000 * a // (count[lang, *w[:k]] + count[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), count[lang, *w[:k]], count[lang, *w[k:]]))
    rows = set()
    for lang, best in out.items():
        for i, (score, a, phrase, left, right) in enumerate(sorted(best)[:top]):
            rows.add((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return rows


@pytest.mark.parametrize("bucket_words,pair_bits", [(1_500_000, 24), (40, 18), (40, 16)])
def test_collocations_equal_brute_force(spark, bucket_words, pair_bits):
    rng = random.Random(5)
    words = ["the", "The", "of", "ünï", "x" * 300, "a-b", "'q'", "3"]
    rows = [(i % 50, "".join(rng.choice(words) + rng.choice([" "] * 9 + ["\t ", ". ", "!", "\n", ", "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"])) for i in range(150)]
    rows += [(i, "hot pair " + rng.choice(words) + " " + rng.choice(words), "en") for i in range(300)] + [(7, "hot pair", "en")] * 40
    rows += [(None, None, "en"), (1, "", None), (2, " \t.\n", "en"), (3, "one two three four " * 3000, "fr"), (4, "of of of of of of " * 40, "fr")]
    got = collocations.collocations(made(spark, rows), pair_bits=pair_bits, triple_bits=16, bucket_words=bucket_words)
    want = brute_phrases([r[1:] for r in rows])
    assert {tuple(r) for r in got.collect()} == want and len(want) > 30
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_top_and_empty(spark):
    rows = [(i, f"w{j} v{j}", "en") for j in range(30) for i in range(30)]
    got = sorted(tuple(r) for r in collocations.collocations(made(spark, rows), top=7, pair_bits=16, triple_bits=16).collect())
    assert got == sorted(brute_phrases([r[1:] for r in rows], top=7)) and len(got) == 7  # ties by the phrase
    assert not collocations.collocations(made(spark, rows).limit(0), pair_bits=16, triple_bits=16).collect()


def test_multikey_quicksort_counts_equal_parts():
    rng = np.random.default_rng(1)
    k = rng.integers(1, 4, (4, 5000)).astype(np.uint64)
    k[3][k[2] == 1] = 0
    weight = rng.integers(1, 3, 5000)
    got = {(tuple(int(k[i][r]) for i in range(n)), a) for r, n, a in collocations.multikey_quicksort(list(k), weight, np.full(5000, 2), 300)}
    want = Counter()
    for n in (2, 3, 4):
        for i in range(5000):
            if k[n - 1][i]:
                want[tuple(int(x) for x in k[:n, i])] += int(weight[i])
    assert got == {(p, a) for p, a in want.items() if a >= 300}


# --- byte pairs


@pytest.fixture(scope="module")
def library():
    ranks = byte_pairs.coder(byte_pairs.read_ranks(PATH)).ranks
    return tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_public_one():
    assert byte_pairs.PATTERN == vocabularies.PATTERN


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.one_of(st.sampled_from("  'strevmld\n\tS1.é中٣ǅ\x1c\x85　"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=6), chunk=st.sampled_from([7, 1 << 20]))
def test_byte_pairs_equal_the_library(library, texts, chunk):
    coder = byte_pairs.coder(byte_pairs.read_ranks(PATH))
    for first, end, data, offsets in tokens.chunks(pa.array(texts, pa.string()), chunk):
        coder.prepare([(data, offsets)])
        ids, size = coder.encode(data, offsets)
        cut = np.concatenate(([0], np.cumsum(size)))
        assert [ids[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])] == [library.encode_ordinary(t) for t in texts[first:end]]
        assert coder.decode(ids, size) == [t.encode() for t in texts[first:end]]


def test_long_pieces_equal_the_library(library, monkeypatch):
    rng = random.Random(2)
    todo = [b"a" * 5000, b"ab" * 700 + b"c", "".join(rng.choice("acgt") for _ in range(4000)).encode(), "".join(rng.choice("éèü中") for _ in range(300)).encode(), b"x" * 65, bytes(range(256)) * 3]
    coder = byte_pairs.coder(byte_pairs.read_ranks(PATH))
    for rows in (2_000_000, 30_000):  # the recursion in one part, and in several
        monkeypatch.setattr(byte_pairs, "RECURSION_ROWS", rows)
        ids, size = coder.contracted(todo)
        assert ids.tolist() == [i for t in todo for i in library._encode_single_piece(t)] and size.sum() == len(ids)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 1)
    coder = byte_pairs.Coder(byte_pairs.read_ranks(PATH))
    for text in ("unwahrscheinlichst qqzzkj", "qqzzkj anders", "unwahrscheinlichst"):
        data = np.frombuffer(text.encode(), np.uint8)
        coder.prepare([(data, np.array([0, len(data)]))])
        assert coder.encode(data, np.array([0, len(data)]))[0].tolist() == library.encode_ordinary(text)


def test_byte_pairs_of_documents(spark, library):
    texts = {1: "It's  a\n\ntest…", 2: None, 3: "", 4: "word " * 20_000, 5: "</s><|endoftext|>"}
    docs = made(spark, [*((i, t, "en") for i, t in texts.items()), (None, "no id", None), (1, texts[1], "en")])
    got = byte_pairs.digest(docs, PATH).collect()
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert len(got) == 7 and byte_pairs.digest(docs.limit(0), PATH).count() == 0
    back = byte_pairs.decode(byte_pairs.encode(docs, PATH).withColumn("ids", F.when(F.col("doc_id") == 3, None).otherwise(F.col("ids"))), PATH)
    assert {r.doc_id: bytes(r.decoded).decode() for r in back.collect()} == {**{i: t or "" for i, t in texts.items()}, None: "no id"}


def test_op12_equals_the_library(spark, library):
    from sparsefold.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op12_byte_bpe"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


# --- importance resampling


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target):
    held = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for *_, f in held for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out, able = [], []
    for i, n, f in held:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return out


def sortable(rows):
    return sorted(map(tuple, rows), key=str)


def test_resampling_equals_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = importance.resample(docs, bench)
    assert got.columns == importance.RESULT
    assert sortable(got.collect()) == sortable(brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()]))


def test_resampling_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000)) + " " + "y" * 500
    words = [" ".join(random.Random(i).choices("alpha beta gamma delta".split(), k=25)) for i in range(60)]
    rows = [*((i, w, "en") for i, w in enumerate(words)), (None, words[0], None), (99, None, "en"), (98, "", "en"), (97, long, "en"), *[(5, words[5], "en")] * 3]
    got = importance.resample(made(spark, rows), spark.createDataFrame([("Alpha beta",), (None,)], "text string"))
    assert sortable(got.collect()) == sortable(brute_resample([r[:2] for r in rows], ["Alpha beta", None]))
    few = importance.resample(made(spark, rows[:10]), spark.createDataFrame([], "text string"))
    assert sortable(few.collect()) == sortable(brute_resample([r[:2] for r in rows[:10]], []))
    assert importance.resample(made(spark, rows).limit(0), spark.createDataFrame([], "text string")).count() == 0


@pytest.mark.parametrize("pivots", [1, 4, 31])
def test_kth_key_with_ties(spark, pivots):
    rng = random.Random(pivots)
    rows = [(rng.randint(0, 5), rng.randint(0, 3), i) for i in range(90)]
    df = spark.createDataFrame(rows, "score long, _order long, _row long").cache()
    order = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for k in (1, 2, 45, 90):
        assert importance.kth_key(df, k, pivots=pivots) == order[k - 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=20))
def test_crc_of_spans(words):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    assert importance.crc32s(data, ends - np.array([len(w) for w in words], np.int64), ends).tolist() == [zlib.crc32(w) for w in words]
