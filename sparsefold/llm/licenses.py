"""License scan by diagonal voting.

A rolling hash of every word k-gram of every whole text is joined to the template positions that hold it, and the
words of what met are compared. A phrase is one k-gram of all its words; notices and whole licenses are cut into
4-grams. Hits of one document and template with the same offset (word position minus template position) lie on one
diagonal. Diagonals with enough votes are merged with neighbours (an inserted or missing word shifts the offset) and
the merged span is verified: the share of template k-grams found, and a length near the template's. A short phrase
must fill its diagonal, so its words stand consecutively.

Words are hashed once, and the hashes of k words come from those of fewer by Horner's rule modulo a prime. Up to a
number of distinct template hashes they are part of the expression, so only places that hit leave a text, which is then
split once and written with its number of words; with more, all k-grams are exchanged or met by a broadcast of
bounded size.

Defined cases: null text is empty and has no words, labels or places; rows equal in doc_id and text get equal
results (each row one result, hits counted once); rows that share only a doc_id are separate documents; an
empty table gives no rows; very long texts are ordinary rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import ascii_lower, save

#: Phrases whose places count as base, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Opening words of well-known license notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "licensed under cc by nc": "cc-by-nc",
}
#: Whole texts of short public licenses.
LICENSES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Template k-grams that may be broadcast, and distinct hashes of them that may stand in an expression.
BROADCAST_GRAMS = 200_000
MOST_LITERALS = 5_000
#: Words of a k-gram of notices and licenses.
NOTICE_GRAM = 4
#: The rolling hash: base and modulus.
BASE, PRIME = 1_000_003, (1 << 31) - 1


def _words(text) -> F.Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def _rolled(words: str, k: int) -> str:
    """SQL for the hashes of all runs of ``k`` words of the array ``words``."""
    rolled, width = f"transform({words}, x -> pmod(xxhash64(x), {PRIME}L))", 1
    for bit in bin(k)[3:]:  # twice as many words, then one more where the binary digit is 1
        shift = pow(BASE, width, PRIME)
        rolled = f"transform(array({rolled}), r -> if(size(r) <= {width}, array(), transform(sequence(0, size(r) - {width + 1}), i -> (r[i] * {shift}L + r[i + {width}]) % {PRIME}L)))[0]"
        width *= 2
        if bit == "1":
            one = f"transform({words}, x -> pmod(xxhash64(x), {PRIME}L))"
            rolled = f"transform(array(struct({rolled} as r, {one} as o)), p -> if(size(p.r) < 2, array(), transform(sequence(0, size(p.r) - 2), i -> (p.r[i] * {BASE}L + p.o[i + {width}]) % {PRIME}L)))[0]"
            width += 1
    return rolled


def templates(spark, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = {**NOTICES, **LICENSES}, gram: int = NOTICE_GRAM) -> DataFrame:
    """One row per template position: template, label, kind, k, position, k-gram and its hash, and the template's number of k-grams."""
    rows = []
    for kind, texts in (("phrase", phrases), ("notice", notices)):
        for text, label in texts.items():
            w = text.split()
            k = len(w) if kind == "phrase" else min(gram, len(w))
            if not w:
                raise ValueError("a template needs a word")
            rows += [(f"{kind}:{text}", label, kind, k, i, " ".join(w[i : i + k]), len(w) - k + 1) for i in range(len(w) - k + 1)]
    got = spark.createDataFrame(rows, "template string, label string, kind string, k int, at int, gram string, n_grams int")
    sizes = sorted({r[3] for r in rows})
    h = "case k " + " ".join(f"when {k} then {_rolled('split(gram, chr(32))', k)}[0]" for k in sizes) + " end"
    return got.withColumn("h", F.expr(h))


def located(docs: DataFrame, templates: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, hits): the places of a text whose k-gram may be a template's, with its hash and words."""
    known = [r.k for r in templates.select("k").distinct().collect()]
    few = templates.select("k", "h").distinct().limit(MOST_LITERALS + 1).collect()
    out = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), _words(F.col(text)).alias("w"))
    out = out.select("*", *[F.expr(_rolled("w", k)).alias(f"r{k}") for k in known])
    each = []
    for k in known:
        mine = ", ".join(f"{r.h}L" for r in few if r.k == k)
        hit = f"r{k}[i] IN ({mine})" if len(few) <= MOST_LITERALS else "true"
        each.append(f"if(size(r{k}) < 1, array(), transform(filter(sequence(0, size(r{k}) - 1), i -> {hit}), i -> struct(i as pos, {k} as k, r{k}[i] as h, array_join(slice(w, i + 1, {k}), ' ') as gram)))")
    out = out.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.expr(f"concat({', '.join(each)})").alias("hits"))
    return save(out, "located") if len(few) <= MOST_LITERALS else out


def hits(places: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, kind, n_grams, diagonal, at): every place where a k-gram of a document is one of a template's."""
    grams = places.select("doc_id", "text_hash", F.inline("hits"))
    few = templates.count() <= BROADCAST_GRAMS
    return grams.join(F.broadcast(templates) if few else templates, ["h", "k", "gram"]).select(
        "doc_id", "text_hash", "template", "label", "kind", "n_grams", (F.col("pos") - F.col("at")).cast("long").alias("diagonal"), "at"
    )


def scan(docs: DataFrame, text: str = "text", templates_df: DataFrame | None = None, least_votes: int = 3, slack: int = 4, least_cover: float = 0.8, longest: float = 1.5) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    held = templates(docs.sparkSession) if templates_df is None else templates_df
    every = located(docs, held, text)
    found = hits(every, held)
    key, tpl = ["doc_id", "text_hash"], ["template", "label", "kind", "n_grams"]
    diagonals = found.groupBy(*key, *tpl, "diagonal").agg(F.collect_set("at").alias("ats"))  # at most a template's length
    diagonals = diagonals.where(F.size("ats") >= F.when(F.col("kind") == "phrase", F.col("n_grams")).otherwise(F.least(F.col("n_grams"), F.lit(least_votes))))
    along = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.when((F.col("kind") == "phrase") | (F.col("diagonal") - F.lag("diagonal").over(along) > slack), 1).otherwise(0)
    merged = diagonals.withColumn("run", apart).withColumn("run", F.sum("run").over(along)).groupBy(*key, *tpl, "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        F.min(F.col("diagonal") + F.array_min("ats")).alias("first"),
        F.max(F.col("diagonal") + F.array_max("ats") + 1).alias("last"),
        F.min("diagonal").alias("start"),
    )
    merged = merged.withColumn("cover", F.col("covered") / F.col("n_grams"))
    verified = merged.where((F.col("cover") >= least_cover) & (F.col("last") - F.col("first") <= longest * (F.col("n_grams") + 1)))
    base = F.col("kind") == "phrase"
    per_doc = verified.groupBy(*key).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    per_doc = per_doc.withColumnsRenamed({"doc_id": "k_doc_id", "text_hash": "k_text_hash"})
    joined = every.join(per_doc, F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & (F.col("text_hash") == F.col("k_text_hash")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql(phrases=PHRASES, notices={**NOTICES, **LICENSES}, least_votes=3, slack=4, least_cover=0.8, longest=1.5) -> str:
    rows = [(kind, text, label, len(text.split()) if kind == "phrase" else NOTICE_GRAM) for kind, texts in (("phrase", phrases), ("notice", notices)) for text, label in texts.items()]
    sizes = ", ".join(f"({k})" for k in sorted({r[3] for r in rows}))
    return f"""
WITH tpl0 AS (SELECT *, string_split(phrase, ' ') AS tw FROM (VALUES {', '.join(map(str, rows))}) v(kind, phrase, label, k)),
tpl AS (SELECT kind, phrase, label, k, len(tw) - k + 1 AS n_grams, i AS tpos, array_to_string(list_slice(tw, i + 1, i + k), ' ') AS gram FROM (SELECT *, unnest(range(0, len(tw) - k + 1)) AS i FROM tpl0)),
d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, k, i AS pos, array_to_string(list_slice(w, i + 1, i + k), ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, (VALUES {sizes}) s(k) WHERE len(w) >= k)),
h AS (SELECT doc_id, kind, phrase, label, n_grams, pos - tpos AS diagonal, list_distinct(list(tpos)) AS ats FROM g JOIN tpl USING (k, gram) GROUP BY doc_id, kind, phrase, label, n_grams, pos - tpos),
h2 AS (SELECT * FROM h WHERE len(ats) >= CASE WHEN kind = 'phrase' THEN n_grams ELSE least(n_grams, {least_votes}) END),
r0 AS (SELECT *, CASE WHEN kind = 'phrase' OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, kind, phrase ORDER BY diagonal) > {slack} THEN 1 ELSE 0 END AS apart FROM h2),
r AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, kind, phrase ORDER BY diagonal) AS run FROM r0),
m AS (SELECT doc_id, kind, phrase, label, n_grams, run, len(list_distinct(flatten(list(ats)))) / n_grams AS cover, min(diagonal + list_min(ats)) AS f, max(diagonal + list_max(ats) + 1) AS l, min(diagonal) AS start FROM r GROUP BY doc_id, kind, phrase, label, n_grams, run),
v AS (SELECT * FROM m WHERE cover >= {least_cover} AND l - f <= {longest} * (n_grams + 1)),
p AS (SELECT doc_id, count(*) FILTER (kind = 'phrase') AS n_base, min(start) FILTER (kind = 'phrase') AS first_word, max(start) FILTER (kind = 'phrase') AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'phrase'), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM v GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN p USING (doc_id)"""


ORACLE_SQL = _sql()
