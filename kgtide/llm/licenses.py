"""License scans by diagonal voting.

Every word k-gram of a text is joined by its hash to the positions of the same
k-gram in license templates.  A hit at word p of template position t votes for
the diagonal p - t, the word where the template would start.  Neighbouring
diagonals merge (inserted or dropped words shift a copy), and a merged span
counts if it covers enough of its template within a bounded width.  Cover counts distinct positions of the template, so a k-gram
that stands twice counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii

K = 3
#: Diagonals at most this far apart belong to one copy.
DRIFT = 3
#: Share of a template's k-grams that a fuzzy copy must hold.
COVER = 0.6

#: Fixed phrases: (label, words); a place counts only if every word stands there.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Short wordings of public licenses: (label, words); found where every word stands.
SHORT = (
    ("agpl", "under the gnu affero general public license"),
    ("agpl", "terms of the gnu affero general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd", "spdx license identifier bsd 2 clause"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("bsd", "under the bsd license"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl", "spdx license identifier gpl 2 0"),
    ("gpl", "spdx license identifier gpl 3 0"),
    ("gpl", "under the gnu general public license"),
    ("gpl", "terms of the gnu general public license"),
    ("isc", "spdx license identifier isc"),
    ("lgpl", "under the gnu lesser general public license"),
    ("lgpl", "terms of the gnu lesser general public license"),
    ("mit", "spdx license identifier mit"),
    ("mpl-2", "spdx license identifier mpl 2 0"),
    ("mpl-2", "terms of the mozilla public license"),
    ("unlicense", "released into the public domain"),
)

#: Public license notices: (label, text); found with some words changed.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("all-rights-reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)


def template_rows(phrases: Iterable[tuple[str, str]] = PHRASES, short: Iterable[tuple[str, str]] = SHORT, notices: Iterable[tuple[str, str]] = NOTICES) -> list[tuple]:
    """(template, label, base, drift, n_grams, need, tpos, gram) of every template position."""
    out = []
    for base, drift, group in ((True, 0, phrases), (False, 0, short), (False, DRIFT, notices)):
        for label, text in group:
            words = text.split()
            if len(words) < K:
                raise ValueError(f"a template needs {K} words: {text!r}")
            name, n = len({r[0] for r in out}), len(words) - K + 1
            out += [(name, label, base, drift, n, math.ceil(COVER * n) if drift else n, i, " ".join(words[i : i + K])) for i in range(n)]
    return out


def scan(docs: DataFrame, templates: list[tuple] | None = None) -> DataFrame:
    """Spans of templates, with a row also for each text without any.

    Columns: rid (of the row), doc_id, n_words, and for a span: template, label,
    base, cover, start and end word (else null).  A null text has no words.
    The templates are a parameter of fixed size and are broadcast.
    """
    spark = docs.sparkSession
    rows = templates or template_rows()
    grams = spark.createDataFrame(rows, "template int, label string, base boolean, drift int, n_grams int, need int, tpos int, tgram string").withColumn("th", F.xxhash64("tgram"))
    split = F.split(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.filter(split, lambda w: w != "").alias("w")).withColumn("n_words", F.size("w").cast("long"))
    each = F.when(
        F.col("n_words") >= K,
        F.transform(F.sequence(F.lit(0), (F.col("n_words") - K).cast("int")), lambda i: F.concat_ws(" ", *(F.get("w", i + k) for k in range(K)))),
    ).otherwise(F.array().cast("array<string>"))
    # The first element, empty, keeps the row; the others are the k-grams in turn.
    spread = words.select("rid", "doc_id", "n_words", F.posexplode(F.concat(F.array(F.lit("")), each)).alias("at", "gram"))
    hits = (
        spread.withColumn("h", F.xxhash64("gram"))
        .join(F.broadcast(grams), (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")), "left")
        .filter((F.col("at") == 0) | F.col("template").isNotNull())
        .select("rid", "doc_id", "n_words", "template", "label", "base", "drift", "n_grams", "need", "tpos", (F.col("at") - 1 - F.col("tpos")).cast("long").alias("diagonal"))
        .repartition("rid")
    )
    # A word and a template position meet once, so (diagonal, tpos) is unique for a row and a template.
    by = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.col("drift"), F.lit(True))
    span = ["rid", "doc_id", "n_words", "template", "label", "base", "drift", "n_grams", "need", "span"]
    merged = (
        hits.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(by))
        .groupBy(*span, "tpos").agg(F.min("diagonal").alias("least"), F.max("diagonal").alias("most"))
        .groupBy(*span).agg(F.min("least").alias("start"), (F.max("most") + F.first("n_grams") + K - 1).alias("end"), F.count("tpos").alias("found"))
    )
    holds = (F.col("found") >= F.col("need")) & (F.col("end") - F.col("start") <= 2 * (F.col("n_grams") + K - 1))
    kept = [F.when(holds, F.col(c)).alias(c) for c in ("template", "label", "base", "start", "end")]
    return merged.select("rid", "doc_id", "n_words", F.when(F.col("template").isNotNull(), F.col("found") / F.col("n_grams")).alias("cover"), *kept)


def op2_license_scan(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), repeated and null ids too.

    A null text is empty; very long texts are scanned whole; other columns are not
    looked at; an empty table gives an empty result.  ``score`` is the
    largest share of a template's k-grams that a span holds.
    """
    base = F.col("base") & F.col("template").isNotNull()
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (
        scan(docs).groupBy("rid", "doc_id", "n_words")
        .agg(
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("start"))).alias("first_word"),
            F.max(F.when(base, F.col("start"))).alias("last_word"),
            listed(F.when(base, F.col("label"))).alias("base_labels"),
            listed(F.col("label")).alias("labels"),
            F.round(F.coalesce(F.max("cover"), F.lit(0.0)), 6).alias("score"),
        )
        .drop("rid")
    )


def op2_sql() -> str:
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {drift}, {n}, {need}, {i}, '{gram}')" for t, label, base, drift, n, need, i, gram in template_rows())
    return rf"""
WITH templates(template, label, base, drift, n_grams, need, tpos, tgram) AS (VALUES {values}),
words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT rid, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram
  FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM words)),
hits AS (
  SELECT rid, template, label, base, drift, n_grams, need, tpos, i - tpos AS diagonal FROM grams JOIN templates ON gram = tgram),
spans AS (
  SELECT *, sum(CASE WHEN coalesce(diagonal - before > drift, true) THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) AS before FROM hits)),
merged AS (
  SELECT rid, label, base, n_grams, need, min(diagonal) AS a, max(diagonal) + n_grams + {K - 1} AS b, count(DISTINCT tpos) AS found
  FROM spans GROUP BY rid, template, label, base, n_grams, need, span),
judged AS (
  SELECT *, found::DOUBLE / n_grams AS cover, found >= need AND b - a <= 2 * (n_grams + {K - 1}) AS holds FROM merged)
SELECT doc_id, len(w)::BIGINT AS n_words,
  count(*) FILTER (holds AND base) AS n_base,
  (min(a) FILTER (holds AND base))::BIGINT AS first_word, (max(a) FILTER (holds AND base))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds AND base), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (holds), '') AS labels,
  round(coalesce(max(cover), 0.0), 6) AS score
FROM words LEFT JOIN judged USING (rid) GROUP BY rid, doc_id, len(w)"""
