"""Byte-level byte-pair encoding and decoding by recursive DuckDB queries inside the tasks.

Texts are cut into pieces by classes of code points, as the pattern of public byte-level vocabularies does; equal pieces
of a task are encoded once. A piece that is a token is done. For the others, rows (piece, position, token) join the
table of merges, and a recursive query contracts each piece's leftmost pair of least rank until none is left. Ids join
the vocabulary for decoding, and an ordered aggregation puts their bytes together.

Long pieces contract all disjoint pairs of their least rank at once, unless the token made is part of a merge of lower
rank; their recursion is carried on in parts, so that its rows stay bounded.

Defined cases: a null text is empty and has no ids; a null doc_id stays null; repeated rows are encoded like others;
texts and pieces of any length are read whole; characters without a class stand with punctuation; an empty table gives
no rows; other columns are not carried. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship
from .tokens import chunks, span_hashes

#: The pattern that :func:`pieces` follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Pieces up to so many bytes contract one pair a step.
SHORT = 64
#: Bytes of text whose unknown pieces are encoded together.
GROUP = 8 << 20
#: Pieces that a task remembers, pieces of one query, and rows that a recursion over long pieces makes at once.
REMEMBERED = 300_000
LEARNED = 60_000
RECURSION_ROWS = 2_000_000

#: One pair of each piece a step: the removed row lends its end and its successor to the row that takes it in.
SHORT_SQL = """
WITH RECURSIVE paired AS (SELECT s.w, s.p, s.p + 1 AS e, s.t, r.t AS nt, m.id FROM start s LEFT JOIN start r ON r.w = s.w AND r.p = s.p + 1 LEFT JOIN merges m ON m.l = s.t AND m.r = r.t),
step AS (
 SELECT w, p, e, t, nt, id, 0 AS n FROM paired
 UNION ALL
 (WITH least AS MATERIALIZED (SELECT w, min(k) AS k, arg_min(e, k) AS e FROM (SELECT w, e, (CAST(id AS BIGINT) << 32) | p AS k FROM step WHERE id IS NOT NULL) GROUP BY w),
 taken AS MATERIALIZED (SELECT s.w, k & 4294967295 AS spot, CAST(k >> 32 AS INTEGER) AS made, s.p AS gone, s.e, s.nt FROM step s JOIN least ON s.w = least.w AND s.p = least.e),
 left_rows AS (SELECT s.w, s.p, CASE WHEN s.p = spot THEN taken.e ELSE s.e END AS e, CASE WHEN s.p = spot THEN made ELSE s.t END AS t,
   CASE WHEN s.p = spot THEN taken.nt WHEN s.e = spot THEN made ELSE s.nt END AS nt, s.n FROM step s JOIN taken USING (w) WHERE s.p <> gone)
 SELECT x.w, x.p, x.e, x.t, x.nt, m.id, x.n + 1 FROM left_rows x LEFT JOIN merges m ON m.l = x.t AND m.r = x.nt))
SELECT w, p, t FROM step JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n) ORDER BY w, p"""
#: All disjoint pairs of the least rank of a piece, from the left, or the first alone; at most ``steps`` steps.
LONG_SQL = """
WITH RECURSIVE step AS (
 SELECT w, p, t, 0 AS n FROM start
 UNION ALL
 (WITH ahead AS (SELECT w, p, t, n, lead(t) OVER s AS nt, row_number() OVER s AS i FROM step WHERE n < $steps WINDOW s AS (PARTITION BY w ORDER BY p)),
 ranked AS (SELECT a.w, a.p, a.t, a.n, a.i, m.id, min(m.id) OVER (PARTITION BY a.w) AS made FROM ahead a LEFT JOIN merges m ON m.l = a.t AND m.r = a.nt),
 hits AS (SELECT *, coalesce(id = made, false) AS hit FROM ranked WHERE made IS NOT NULL),
 counted AS (SELECT *, row_number() OVER (PARTITION BY w, hit ORDER BY p) AS h FROM hits),
 chosen AS (SELECT *, hit AND CASE WHEN made IN (SELECT id FROM alone) THEN h = 1 ELSE row_number() OVER (PARTITION BY w, hit, i - h ORDER BY p) % 2 = 1 END AS taken FROM counted),
 marked AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY p), false) AS gone FROM chosen)
 SELECT w, p, CASE WHEN taken THEN made ELSE t END, n + 1 FROM marked WHERE NOT gone))
SELECT w, p, t, n FROM step QUALIFY n = max(n) OVER (PARTITION BY w) ORDER BY w, p"""
DECODE_SQL = "SELECT d, string_agg(piece, '' ORDER BY p) AS text FROM tokens JOIN vocabulary ON id = t GROUP BY d"


@cache
def classes() -> np.ndarray:
    """The class of each code point, by the Unicode tables of the library whose ids are to be met."""
    import tiktoken

    points = np.setdiff1d(np.arange(0x110000, dtype=np.uint32), np.arange(0xD800, 0xE000, dtype=np.uint32))
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)
        out[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the pieces that cover the UTF-8 texts of ``data``."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    kind, n = classes()[points], len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(place, offsets)] = True
    change = np.append(kind[1:] != kind[:-1], True)
    change = np.concatenate(([True], change)) | first
    begins = change.copy()
    # the white space before a word: a blank goes with it, other white space stands alone
    after = np.flatnonzero(change[1:n] & ~first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    begins[after - 1] = True
    begins[after[points[after - 1] == 0x20]] = False
    # an apostrophe alone, with the letters of a short form after it
    quote = np.flatnonzero((points == 0x27) & change[:n] & change[1:] & begins[:n] & ~first[1:])
    one, two = (np.append(points, [0, 0])[quote + i] for i in (1, 2))
    length = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
    double = np.zeros(len(quote), bool)
    for a, b in (b"re", b"ve", b"ll"):
        double |= (one == a) & (two == b)
    length[double & ~first[quote + 2 - (quote + 2 > n)]] = 2
    quote, length = quote[length > 0], length[length > 0]
    begins[quote + 1] = False
    begins[quote + 1 + length] = True
    at = np.flatnonzero(begins[:n])
    starts = place[at]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``."""
    total = int(lengths.sum())
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


class Coder:
    """A vocabulary in DuckDB tables, and the ids of pieces met so far."""

    def __init__(self, ranks: bytes):
        import duckdb

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        l, r, made = np.array(merges or np.zeros((0, 3)), np.int32).T
        single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        alone = np.unique(np.concatenate([x[(x > made) & ~np.isin(x, single)] for x in (l, r)]))
        self.single, self.con = single, duckdb.connect(":memory:")
        self.con.execute("SET threads = 1; SET memory_limit = '400MB'; SET temp_directory = ''")
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in self.ranks]})
        for name, rows in (("merges", pa.table({"l": l, "r": r, "id": made})), ("alone", pa.table({"id": alone})), ("vocabulary", vocabulary)):
            self.con.register("given", rows)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self._forget()

    def _forget(self) -> None:
        self.known = {t: i for i, t in enumerate(self.ranks)}
        self.flat, self.used = np.fromiter(self.ranks.values(), np.int32, len(self.ranks)), len(self.ranks)
        self.first, self.size = np.arange(self.used), np.ones(self.used, np.int64)

    def _query(self, sql: str, rows: pa.Table, name: str = "start", **values) -> pa.Table:
        self.con.register(name, rows)
        try:
            return self.con.sql(sql, params=values).to_arrow_table() if values else self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _bytes(self, todo: list[bytes]) -> pa.Table:
        size = np.fromiter(map(len, todo), np.int64, len(todo))
        data = np.frombuffer(b"".join(todo), np.uint8)
        place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        return pa.table({"w": np.repeat(np.arange(len(todo), dtype=np.int32), size), "p": place.astype(np.int32), "t": self.single[data]})

    def contracted(self, todo: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        if max(map(len, todo)) <= SHORT:
            got = self._query(SHORT_SQL, self._bytes(todo))
        else:
            rows, done = self._bytes(todo), []
            while len(rows):
                steps = max(1, RECURSION_ROWS // len(rows))
                got = self._query(LONG_SQL, rows, steps=steps)
                over = pa.compute.less(got["n"], steps)
                done.append(got.filter(over).select(["w", "p", "t"]))
                rows = got.filter(pa.compute.invert(over)).select(["w", "p", "t"])
            got = pa.concat_tables(done).sort_by([("w", "ascending"), ("p", "ascending")])
        return got["t"].to_numpy().astype(np.int32), np.bincount(got["w"].to_numpy(), minlength=len(todo))

    def learn(self, unknown: list[bytes]) -> None:
        """Encode pieces that are neither tokens nor remembered."""
        for group in ([u for u in unknown if len(u) <= SHORT], [u for u in unknown if len(u) > SHORT]):
            for i in range(0, len(group), LEARNED):
                todo = group[i : i + LEARNED]
                ids, size = self.contracted(todo)
                self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
                self.size = np.concatenate((self.size, size))
                self.flat = np.concatenate((self.flat, ids))
                self.known.update(zip(todo, range(len(self.known), len(self.known) + len(todo))))

    def prepare(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Encode the unknown pieces of several chunks, bytes and offsets of each, by as few queries as can be."""
        if len(self.known) > len(self.ranks) + REMEMBERED:
            self._forget()
        unknown: set[bytes] = set()
        for data, offsets in texts:
            unknown.update(w for w in self._distinct(data, offsets)[0] if w not in self.known)
        if unknown:
            self.learn(list(unknown))

    @staticmethod
    def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        starts, ends, row = pieces(data, offsets)
        _, at, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        return [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], inverse, row

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a prepared chunk one after another, and how many each has."""
        own, inverse, row = self._distinct(data, offsets)
        index = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))[inverse]
        size = self.size[index]
        return self.flat[_ragged(self.first[index], size)], np.bincount(row, size, len(offsets) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        out = [b""] * len(size)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        got = self._query(DECODE_SQL, pa.table({"d": np.repeat(np.arange(len(size), dtype=np.int32), size), "p": place, "t": ids}), "tokens")
        for d, text in zip(got["d"].to_pylist(), got["text"].to_pylist()):
            out[d] = text.encode("latin-1")
        return out


@cache
def coder(ranks: bytes) -> Coder:
    return Coder(ranks)


def _lists(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(ids, pa.int32()))


def _grouped(texts: pa.Array) -> Iterator[list[tuple]]:
    group, size = [], 0
    for chunk in chunks(texts):
        group.append(chunk)
        size += len(chunk[2])
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encoded(ranks: bytes, decoded: bool):
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            for group in _grouped(batch.column(1)):
                own.prepare([c[2:] for c in group])
                for first, end, data, offsets in group:  # batches of the output stay as small as the chunks of the input
                    ids, size = own.encode(data, offsets)
                    columns = [batch.column(0).slice(first, end - first), _lists(ids, size)]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array(own.decode(ids, size), pa.binary())] * decoded], names=names)

    return run


def _decoded(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            lists = batch.column(1).fill_null([])
            size = np.diff(lists.offsets.to_numpy())
            for a in range(0, len(batch), 200):
                part = lists.slice(a, 200)
                text = own.decode(part.flatten().to_numpy().astype(np.int32), size[a : a + 200].astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 200), pa.array(text, pa.binary())], names=["doc_id", "decoded"])

    return run


def read_ranks(path: str) -> bytes:
    """A vocabulary file of lines ``base64 rank``; the tasks get its bytes, not its path."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of every document, with the bytes decoded from the ids if asked for."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(f"`{text}`").alias("text")).mapInArrow(_encoded(read_ranks(path), decoded), f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded): the bytes that (doc_id, ids) stand for; null ids give none."""
    ship(encoded.sparkSession)
    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decoded(read_ranks(path)), f"doc_id {kind}, decoded binary")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the ids of every document and of what they decode to."""
    got = encode(docs, path, decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
