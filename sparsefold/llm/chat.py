"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: each turn is START role MIDDLE text END, and the three marks are single tokens.
Control strings inside roles and texts are escaped by a backslash after their first character (one more where
there are some already), which is undone exactly. The rendered text is encoded once, with offsets; the spans of
the turns' texts and of the tokens are both sorted, so the tokens of each assistant text are found by binary
search, and they make the loss mask. As a mark always ends a token, a long conversation is encoded turn by turn,
about ``PIECE`` characters at a time, which gives the same tokens; offsets and masks are held as NumPy arrays.

A conversation is one training example and is put together in one task; conversations share nothing else.

Defined cases: null text or role is empty; turns are ordered by turn (nulls first), then role and text; repeated
rows are turns; a row with a null conv_id belongs to no other and is a conversation of its own; very long texts and
conversations are encoded whole; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import ship

START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and other common templates. Marks above begin with the first.
CONTROLS = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "conv_id long, n_turns long, formatted string, input_ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Characters that are encoded at once, and tokens of a batch; a longer turn or conversation is worked on alone.
PIECE = 1 << 20
BATCH_TOKENS = 1 << 18

_OPENERS = tuple(dict.fromkeys(c[0] for c in CONTROLS))
_RESTS = {o: "|".join(re.escape(c[1:]) for c in CONTROLS if c[0] == o) for o in _OPENERS}
_ESCAPE = re.compile("|".join(rf"{re.escape(o)}\\*(?:{rests})" for o, rests in _RESTS.items()))
_UNESCAPE = re.compile("|".join(rf"{re.escape(o)}\\+(?:{rests})" for o, rests in _RESTS.items()))


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if any(o in text for o in _OPENERS) else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + MIDDLE, escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = formatted.split(START)[1:]
    return [tuple(unescape(x) for x in t.removesuffix(END).split(MIDDLE)) for t in turns]


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token lies in one of ``spans``; both are sorted, so their bounds are found by binary search."""
    spans = np.array([s for s in spans if s[0] < s[1]], np.int64).reshape(-1, 2)
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, np.searchsorted(ends, spans[:, 0], "right"), 1)
    np.add.at(change, np.searchsorted(starts, spans[:, 1], "left"), -1)
    return np.cumsum(change[:-1]) > 0


@lru_cache(maxsize=2)
def _encoder(spec: str):
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    tokenizer.add_special_tokens([AddedToken(m, normalized=False) for m in (START, MIDDLE, END)])
    return tokenizer


def encoded(encoder, text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, starts and ends of a rendered conversation, encoded in runs of whole turns."""
    ids, starts, ends, at = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], 0
    for i, (_, b) in enumerate(spans):
        stop = b + len(END)
        if i + 1 == len(spans) or spans[i + 1][1] + len(END) - at > PIECE:
            got = encoder.encode(text[at:stop], add_special_tokens=False)
            offsets = np.fromiter(chain.from_iterable(got.offsets), np.int32, 2 * len(got)).reshape(-1, 2) + np.int32(at)
            ids.append(np.array(got.ids, np.int32))
            starts.append(offsets[:, 0])
            ends.append(offsets[:, 1])
            at = stop
    return np.concatenate(ids), np.concatenate(starts), np.concatenate(ends)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(arrays)))


def _formatted(spec: str, loss_roles: frozenset):
    names = ["conv_id", "n_turns", "formatted", "input_ids", "starts", "ends", "loss_mask"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        conv, n, text, *arrays = zip(*rows)
        plain = [pa.array(conv, pa.int64()), pa.array(n, pa.int64()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays([*plain, *(_lists(a) for a in arrays)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            rows, held = [], 0
            for conv, turns in zip(batch.column(0), batch.column(1)):
                turns = [(t["role"] or "", t["text"] or "") for t in turns.as_py()]
                text, spans = render(turns)
                ids, starts, ends = encoded(encoder, text, spans)
                mask = masked(starts, ends, [s for s, (role, _) in zip(spans, turns) if role in loss_roles])
                rows.append((conv.as_py(), len(turns), text, ids, starts, ends, mask))
                held += len(ids)
                if held > BATCH_TOKENS:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def format_conversations(rows: DataFrame, tokenizer: str = TOKENIZER, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> one training example per conversation: formatted text, tokens with offsets, loss mask.

    ``tokenizer`` is the path of a byte-level tokenizer file, read by the driver (a vocabulary has a fixed size).
    """
    ship(rows.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    held = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    alone = rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    return held.unionByName(alone).mapInArrow(_formatted(spec, frozenset(loss_roles)), SCHEMA)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in DIGEST.split(", ")]
    for batch in batches:
        column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        bounds = {n: column[n].offsets.to_numpy() for n in ("starts", "ends", "loss_mask")}
        out = []
        for i, conv in enumerate(column["conv_id"].to_pylist()):
            text = column["formatted"][i].as_py()
            starts, ends, mask = (column[n].values[b[i] : b[i + 1]].to_numpy(zero_copy_only=False) for n, b in bounds.items())
            under = np.flatnonzero(mask)
            # runs of characters under the mask; END stands between texts
            first = np.concatenate(([True], starts[under[1:]] > ends[under[:-1]])) if len(under) else np.zeros(0, bool)
            last = np.append(first[1:], True) if len(under) else first
            loss = "".join(unescape(text[a:b]) for a, b in zip(starts[under[first]].tolist(), ends[under[last]].tolist()))
            turns, sha = parse(text), hashlib.sha256()
            for r, t in turns:
                sha.update(f"{r}\n{t}\n".encode())
            out.append((conv, len(turns), sha.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)


def digest(formatted: DataFrame) -> DataFrame:
    """Read back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""
    ship(formatted.sparkSession)
    return formatted.mapInArrow(_read_back, DIGEST)


def _sql() -> str:
    """The registered query in SQL: what a template that escapes as above must give back."""
    rests = "|".join(f"{re.escape(o)}\\\\*(?:{r})" for o, r in _RESTS.items())
    marks = len(START) + len(MIDDLE) + len(END)
    longer = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{rests}'))"
    return f"""
WITH said AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
keyed AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER (ORDER BY conv_id) END AS alone FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({marks} + {longer('role')} + {longer('text')}) AS BIGINT) AS formatted_chars
FROM keyed GROUP BY conv_id, alone"""


ORACLE_SQL = _sql()
