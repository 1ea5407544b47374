"""Quality rules with thresholds that adapt to each language and source.

Base measures come from every whole text. For documents that pass the base rule, mergeable quantile
sketches are built per (lang, source): counts per bin of fixed edges, for shares bins of a thousandth, for
the word length bins of one per cent of the value, so a quartile is off by half a bin at most and does not
depend on the order of rows. The sketches of a language are merged (added) for sources with few rows, and all
are merged for languages with few rows. A document is kept unless a measure
lies above its group's fence ``q75 + fence * max(q75 - q25, least spread)``, or its mean word length
outside both fences. Everything is DataFrame code: sketches are partial aggregates of one row per bin, so a
hot source costs a few thousand rows per task, and the join back is on (lang, source) with a table of one row
per group.

Defined cases: null or empty text has no words and fails the base rule; null lang or source is a group
of its own; repeated rows are judged alike; a very long text is one row and is measured whole; an empty
table gives no rows; input columns named like an output give way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import BLANKS, extended, hidden, revealed, save, without, words

#: measure -> (least spread of its quartiles, also bounded from below)
MEASURES = {
    "symbol_share": (0.02, False),
    "dup_line_share": (0.10, False),
    "repeat_share": (0.10, False),
    "upper_share": (0.10, False),
    "word_length": (0.75, True),
}
#: Bins of the sketches: of a share, per whole; of the word length, the ratio of a bin's ends.
SHARE_BINS = 1000
LENGTH_RATIO = 1.01
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: Groups whose thresholds may be broadcast (under 200 bytes each); with more, Spark joins by a shuffle.
BROADCAST_GROUPS = 100_000
#: Words covered by 8-word windows whose hash occurs twice or more. ``w`` is bound once by the outer
#: transform; the sort is done only for texts in which a window repeats.
REPEATS = """
transform(array({w}), w -> if(size(w) < 9, 0L,
  transform(array(transform(sequence(1, size(w) - 7), i -> xxhash64(slice(w, i, 8)))), h ->
    if(size(array_distinct(h)) = size(h), 0L,
      transform(array(array_sort(transform(h, (x, i) -> struct(x as h, i as p)))), s ->
        aggregate(
          array_sort(transform(filter(transform(s, (x, j) -> struct(x.p as p,
            (j > 0 and s[greatest(j - 1, 0)].h = x.h) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].h = x.h) as d)),
            x -> x.d), x -> x.p)),
          struct(0L as upto, 0L as n),
          (a, p) -> struct(cast(p + 8 as long) as upto, a.n + p + 8 - greatest(cast(p as long), a.upto) as n),
          a -> a.n))[0]))[0]))[0]
"""


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures and the shares that thresholds apply to."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.translate(t, BLANKS, "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    first = extended(
        docs,
        {
            "_words": words(F.col(text)),
            "word_chars": F.length(blank).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "_lines": lines,
            "_upper": F.length(blank) - F.length(F.translate(blank, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
        },
    )
    second = extended(
        first,
        {
            "n_words": F.size("_words").cast("long"),
            "n_dup_lines": F.expr("transform(array(_lines), l -> size(l) - size(array_distinct(l)))[0]").cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": F.expr(REPEATS.format(w="_words")).cast("long"),
        },
    ).drop("_words", "_lines")
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return extended(
        second,
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "symbol_share": F.col("n_symbols") / chars,
            "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / n,
            "upper_share": F.col("_upper") / chars,
            "word_length": F.col("word_chars") / n,
        },
    ).drop("_upper", "n_lines")


def _bin(measure: str):
    c = F.col(measure)
    binned = F.log(F.greatest(c, F.lit(1e-9))) / F.lit(math.log(LENGTH_RATIO)) if measure == "word_length" else c * SHARE_BINS
    return F.floor(binned).cast("long")


def _middle(measure, at):
    """The value in the middle of a bin."""
    length = F.exp((at + 0.5) * F.lit(math.log(LENGTH_RATIO)))
    return F.when(measure == "word_length", length).otherwise((at + 0.5) / SHARE_BINS)


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): documents that pass the base rule, counted per bin of each measure; sketches merge by adding ``n``."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), _bin(m).alias("bin")) for m in MEASURES])
    rows = measured.where(~F.col("base_failed")).select("lang", "source", F.inline(each))
    return rows.groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, n, q25, q75) of sketches merged by ``keys``; a quartile is the middle of the first bin that holds its rank."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("c"))
    w = Window.partitionBy(*keys, "measure")
    upto = F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    run = merged.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    got = run.groupBy(*keys, "measure", "n").agg(*[F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("bin"))).alias(f"b{k}") for k in (1, 3)])
    return got.select(*keys, "measure", "n", _middle(F.col("measure"), F.col("b1")).alias("q25"), _middle(F.col("measure"), F.col("b3")).alias("q75"))


def thresholds(own: DataFrame, fence: float = 3.0, least_rows: int = 30) -> DataFrame:
    """Fences of each (lang, source): from its own sketch, or from those merged per language or over all rows if it has under ``least_rows``."""

    def named(df, prefix):
        return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])

    by_lang, overall = named(quartiles(own, "lang"), "l_"), named(quartiles(own), "a_")
    wide = quartiles(own, "lang", "source").join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")), "left")
    wide = wide.join(F.broadcast(overall), F.col("measure") == F.col("a_measure"))  # five rows
    q25, q75 = (F.when(F.col("n") >= least_rows, F.col(q)).when(F.col("l_n") >= least_rows, F.col("l_" + q)).otherwise(F.col("a_" + q)) for q in ("q25", "q75"))
    wide = wide.select("lang", "source", "measure", q25.alias("lo"), q75.alias("hi"))
    out = []
    for m, (spread, both) in MEASURES.items():
        reach = fence * F.greatest(F.col("hi") - F.col("lo"), F.lit(spread))
        out.append(F.max(F.when(F.col("measure") == m, F.col("hi") + reach)).alias("hi_" + m))
        if both:
            out.append(F.max(F.when(F.col("measure") == m, F.col("lo") - reach)).alias("lo_" + m))
    fences = wide.groupBy("lang", "source").agg(*out)
    return fences.withColumnsRenamed({"lang": "t_lang", "source": "t_source"}).withColumn("t_known", F.lit(True))


def quality_rules(docs: DataFrame, text: str = "text", fence: float = 3.0, least_rows: int = 30, carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the base measures, ``base_failed`` and ``kept``.

    The measured rows are written once to the shared folder, as both the sketches and the join read them.
    Groups without a document that passes the base rule have no fences; their documents all failed.
    """
    docs, names = hidden(without(docs, [*BASE, *MEASURES, "kept"]), keep=("lang", "source"))
    measured = measure(docs, names[text])
    if carry is not None:
        names = {c: names[c] for c in dict.fromkeys([*carry, "lang", "source"]) if c in names}
    measured = save(measured.select(*names.values(), *BASE, *MEASURES), "quality")
    limits = save(thresholds(sketches(measured), fence, least_rows), "limits")
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    inside = F.coalesce(F.col("t_known"), F.lit(False))
    for m, (_, both) in MEASURES.items():
        inside &= F.col(m) <= F.col("hi_" + m)
        if both:
            inside &= F.col(m) >= F.col("lo_" + m)
    return revealed(joined, names, *BASE, *MEASURES, F.when(F.col("base_failed"), F.lit(False)).otherwise(inside).alias("kept"))


def _sql(fence: float = 3.0, least_rows: int = 30) -> str:
    """The registered query in SQL."""
    ratio, blank = repr(math.log(LENGTH_RATIO)), "[\\x20\\x09-\\x0D]"
    binned = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, CAST(floor({f'ln(greatest({m}, 1e-9)) / {ratio}' if m == 'word_length' else f'{m} * {SHARE_BINS}'}) AS BIGINT) AS bin FROM m WHERE NOT base_failed"
        for m in MEASURES
    )

    def quartile(name, keys):
        k = "".join(f"{x}, " for x in keys)
        middle = lambda b: f"CASE WHEN measure = 'word_length' THEN exp(({b} + 0.5::DOUBLE) * {ratio}) ELSE ({b} + 0.5::DOUBLE) / {SHARE_BINS} END"
        return f"""{name}0 AS (SELECT {k}measure, bin, sum(count(*)) OVER (PARTITION BY {k}measure ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY {k}measure) AS n FROM b GROUP BY {k}measure, bin),
{name}1 AS (SELECT {k}measure, n, min(bin) FILTER (4 * upto >= n) AS b1, min(bin) FILTER (4 * upto >= 3 * n) AS b3 FROM {name}0 GROUP BY {k}measure, n),
{name} AS (SELECT {k}measure, n, {middle("b1")} AS q25, {middle("b3")} AS q75 FROM {name}1)"""

    pick = lambda q: f"CASE WHEN o.n >= {least_rows} THEN o.{q} WHEN l.n >= {least_rows} THEN l.{q} ELSE a.{q} END"
    spread = "CASE f.measure " + " ".join(f"WHEN '{m}' THEN {s}::DOUBLE" for m, (s, _) in MEASURES.items()) + " END"
    value = "CASE f.measure " + " ".join(f"WHEN '{m}' THEN m.{m}" for m in MEASURES) + " END"
    lower = "CASE WHEN f.measure IN (" + ", ".join(f"'{m}'" for m, (_, both) in MEASURES.items() if both) + ") THEN lo - reach END"
    return f"""
WITH d AS (SELECT *, row_number() OVER () AS rid, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + 7) AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
h AS (SELECT rid, unnest(list(i)) AS i FROM g GROUP BY rid, gram HAVING count(*) > 1),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM h) GROUP BY rid),
c AS (SELECT doc_id, lang, source, rid, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{blank}', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS upper FROM d LEFT JOIN r USING (rid)),
m AS (SELECT *, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share,
  (len(ln) - len(list_distinct(ln))) / greatest(len(ln), 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share, upper / greatest(word_chars, 1) AS upper_share, word_chars / greatest(n_words, 1) AS word_length FROM c),
b AS ({binned}),
{quartile("o", ["lang", "source"])},
{quartile("l", ["lang"])},
{quartile("a", [])},
p AS (SELECT o.lang, o.source, o.measure, {pick("q25")} AS lo, {pick("q75")} AS hi FROM o LEFT JOIN l ON o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure JOIN a ON a.measure = o.measure),
f AS (SELECT *, {fence} * greatest(hi - lo, {spread.replace('f.measure', 'measure')}) AS reach FROM p),
v AS (SELECT rid, bool_and({value} <= hi + reach AND coalesce({value} >= {lower}, true)) AS inside FROM m JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source GROUP BY rid)
SELECT doc_id, {', '.join(BASE)}, CASE WHEN base_failed THEN false ELSE coalesce(inside, false) END AS kept, {', '.join(MEASURES)} FROM m LEFT JOIN v USING (rid)"""


ORACLE_SQL = _sql()
