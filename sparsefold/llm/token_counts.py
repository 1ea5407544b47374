"""Greedy longest-match token counts by a linear automaton.

The vocabulary is a trie of byte strings. Each node has a failure link, the node reached after its longest-match
tokens are popped, and the number of tokens popped on the way, both computed beforehand. A piece of text is read
once, byte by byte, without going back and without building its tokens. Vocabularies that hold every single byte
cover all texts; otherwise a piece that cannot be split counts as one unknown token.

Pieces are runs of word characters and single other characters, with a space in front where white space stands
before them (or at the start of the text). Counts of pieces are kept per task for texts to come, in a store that
is emptied when it grows too large.

Defined cases: null or empty text has no tokens; ties cannot occur; repeated rows get equal counts; an empty table
gives no rows; input columns named like an output give way.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship, without

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE = re.compile(r"\s*(?:\w+|[^\w\s])")
OUTPUT = {"n_tokens": "long", "n_pieces": "long", "n_unknown": "long"}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file with a base64 token and its rank per line."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped-token counts."""

    def __init__(self, vocabulary):
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        last, parent = [False], [(0, 0)]
        for token in vocabulary:
            v = 0
            for c in token:
                if (nxt := self.child.get(v * 256 + c)) is None:
                    nxt = self.child[v * 256 + c] = len(last)
                    last.append(False)
                    parent.append((v, c))
                v = nxt
            last[v] |= bool(token)
        depth = [0] * len(last)
        for v in range(1, len(last)):  # parents come first
            depth[v] = depth[parent[v][0]] + 1
        self.fail: list[int] = [-1] * len(last)
        self.popped = [0] * len(last)
        for v in sorted(range(1, len(last)), key=depth.__getitem__):
            if last[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            u, c = parent[v]
            z, n = self.fail[u], self.popped[u]
            while z >= 0 and (nxt := self.child.get(z * 256 + c)) is None:
                z, n = self.fail[z], n + self.popped[z]
            if z >= 0:
                self.fail[v], self.popped[v] = nxt, n

    def count(self, piece: bytes) -> int:
        """Tokens of the greedy longest match; -1 if there is none."""
        child, fail, popped = self.child, self.fail, self.popped
        v = n = 0
        for c in piece:
            while (nxt := child.get(v * 256 + c)) is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return -1
            v = nxt
        while v > 0:
            n += popped[v]
            v = fail[v]
        return n if v == 0 else -1


@lru_cache(maxsize=2)
def _automaton(vocabulary: tuple[bytes, ...]) -> Automaton:
    return Automaton(vocabulary)


class _Counts(dict):
    """Tokens by piece, counted when first met."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, piece: str) -> int:
        bare = piece.lstrip()
        n = self.automaton.count((" " + bare if bare != piece else bare).encode())
        if len(piece) <= 64:
            self[piece] = n
        return n


def _counted(vocabulary: tuple[bytes, ...], schema: pa.Schema, text_at: int, most: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(_automaton(vocabulary))
        for batch in batches:
            tokens, pieces, unknown = [], [], []
            for text in batch.column(text_at):
                found = PIECE.findall(" " + (text.as_py() or ""))
                n = list(map(counts.__getitem__, found))
                bad = n.count(-1)
                tokens.append(sum(n) + 2 * bad)
                pieces.append(len(n))
                unknown.append(bad)
                if len(counts) > most:
                    counts.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (tokens, pieces, unknown))], schema=schema)

    return run


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str | None = VOCABULARY, tokens: list[bytes] | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_pieces`` and ``n_unknown``. The vocabulary, a file's path or a list, has a fixed size and goes to every task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    docs = without(docs, OUTPUT)
    shape = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.lit(0).cast(t).alias(k) for k, t in OUTPUT.items()]).schema
    held = tuple(tokens if tokens is not None else read_ranks(vocabulary))
    return docs.mapInArrow(_counted(held, to_arrow_schema(shape), docs.columns.index(text)), shape)
