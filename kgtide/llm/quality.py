"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a statistic of a text, in thousandths; a text fails at or above a
cutoff.  Cutoffs come from labelled rows: in each stratum (the language), and
for each rule and candidate cutoff, k of the n good rows would be rejected.  A
cutoff is certified if P(Bin(n, risk) <= k) <= delta / tests, that is, if the
exact (Clopper-Pearson) upper bound of its false-rejection rate is at most the
rule's share of the risk; tests counts all strata, rules and cutoffs
(Bonferroni).  With probability 1 - delta, then, no stratum loses more than the
risk.  Of the certified cutoffs the one with the largest surplus of bad rows
over good ones is used; without one, the rule is silent in that stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, broadcast_if_small, cut, ws_words

RULES = ("symbols", "repeats", "dup_lines", "marks")
CUTOFFS = (10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
#: Largest share of good rows that a stratum may lose, and the chance that one loses more.
RISK, DELTA = 0.05, 0.05

SYMBOLS, MARKS = "#*$%&|<>", "!?|"


def _without(c: Column, chars: str) -> Column:
    """``c`` less the given characters; a replacement for each is cheaper than
    one translation, as most are rare."""
    for x in chars:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with the counts and rule statistics of each text.

    Null and empty texts have no words.  Two 3-word windows count as equal if
    their 64-bit hashes are, within one text.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = lambda names: [F.col(c) for c in (*keep, *names)]
    at0 = docs.select(
        *keep,
        ws_words(t).alias("_w"),
        F.length(_without(t, WS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(_without(t, MARKS))).alias("_marks"),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "").alias("_lines"),
    )
    names = ["word_chars", "n_symbols", "_marks"]
    at1 = at0.select(
        *own(names),
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).alias("_g"),
    )
    names += ["n_words", "_n_lines", "n_dup_lines"]
    # Only texts with an equal pair of windows are sorted.
    at2 = at1.select(*own(names), F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    same = lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"])
    at3 = at2.select(*own(names), F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])).alias("_p"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(acc["end"], p)).alias("n"))
    at4 = at3.select(*own(names), F.coalesce(F.aggregate("_p", start, step, lambda acc: acc["n"]), F.lit(0)).cast("long").alias("n_repeat_words"))
    share = lambda a, b: F.coalesce(F.floor(F.lit(1000) * F.col(a) / F.when(F.col(b) > 0, F.col(b))), F.lit(0)).cast("long")
    return at4.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("n_repeat_words", "n_words").alias("repeats"), share("n_dup_lines", "_n_lines").alias("dup_lines"),
        share("_marks", "word_chars").alias("marks"),
    )


def calibrate(rows: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Certified cutoffs: stratum and one nullable column for each rule.

    ``rows`` are features with doc_id; ``labels`` has doc_id and quality.  All
    labelled rows that pass the base rules count.  A document is good if any of
    its labels says so; null ids and labels do not count.  A null stratum is one
    of its own.
    """
    quality = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = rows.filter("not base_failed").join(quality, "doc_id").select(F.col(stratum).alias("_stratum"), "quality", *RULES)
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(r).alias("x")) for r in RULES for c in CUTOFFS)))
    good, hit = F.col("quality") > 0, F.col("x") >= F.col("cutoff")
    # Rows with equal statistics first come down to one with a count.
    counted = known.groupBy("_stratum", "quality", *RULES).agg(F.count("*").alias("m")).select("_stratum", "quality", "m", each.alias("e")).select("_stratum", "quality", "m", "e.*")
    tests = counted.groupBy("_stratum", "rule", "cutoff").agg(
        F.coalesce(F.sum(F.when(good, F.col("m"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(good & hit, F.col("m"))), F.lit(0)).alias("k"),
        F.coalesce(F.sum(F.when(~good & hit, F.col("m"))), F.lit(0)).alias("caught"),
    )
    n_tests = tests.agg(F.count("*").alias("n_tests"))  # one row
    p = risk / len(RULES)
    # P(Bin(n, p) <= k): terms in turn, by their logarithms; k beyond the mean can't pass.
    n, k = F.col("n"), F.col("k")
    log_first = n * F.log1p(F.lit(-p))
    begin = F.struct(log_first.alias("t"), F.exp(log_first).alias("sum"))
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))

    def add(acc: Column, j: Column) -> Column:
        t = acc["t"] + F.log((n - j + 1) / j) + odds
        return F.struct(t.alias("t"), (acc["sum"] + F.exp(t)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(k <= n * p, F.aggregate(steps, begin, add, lambda acc: acc["sum"])).otherwise(F.lit(1.0))
    passed = tests.crossJoin(F.broadcast(n_tests)).withColumn("tail", tail).filter(F.col("tail") <= F.lit(delta) / F.col("n_tests")).filter("caught > k")
    best = lambda r: F.max(F.when(F.col("rule") == r, F.struct((F.col("caught") - k).alias("gain"), F.col("cutoff").alias("cutoff"))))["cutoff"].alias(f"_{r}")
    return passed.groupBy("_stratum").agg(*(best(r) for r in RULES))


def judge(rows: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Adds ``kept`` to feature rows; strata without cutoffs keep what the base
    rules pass.  ``cutoffs`` is a written table."""
    small = broadcast_if_small(cutoffs, 10_000)
    fails = F.lit(False)
    for r in RULES:
        fails = fails | F.coalesce(F.col(r) >= F.col(f"_{r}"), F.lit(False))
    joined = rows.join(small, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~fails).drop("_stratum", *(f"_{r}" for r in RULES))


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A verdict for each row of ``docs`` (doc_id, text, lang), read once.

    Null and empty texts have no words and fail; a null lang is a stratum of its
    own; repeated rows and null ids have a row each; very long texts are judged
    whole; other columns are not looked at.  An empty table gives an empty
    result, and without labels only the base rules judge.
    """
    rows = cut(features(docs, ["doc_id", "lang"]), "features")
    judged = judge(rows, cut(calibrate(rows, labels), "cutoffs"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    whole = docs.select(F.struct("*").alias("_row"), "doc_id", "lang", "text")
    # Written first: a filter on the verdict, pushed into the statistics, would repeat them without end.
    rows = cut(features(whole, ["_row", "doc_id", "lang"]), "features")
    judged = judge(rows, cut(calibrate(rows, labels), "cutoffs"))
    return judged.filter("kept").select("_row.*")


def op10_sql() -> str:
    p = RISK / len(RULES)
    cuts = ", ".join(f"({c})" for c in CUTOFFS)
    pick = ",\n".join(f"  max({{'gain': caught - k, 'cutoff': cutoff}}) FILTER (rule = '{r}') AS {r}" for r in RULES)
    rules = " UNION ALL ".join(f"SELECT lang, quality, '{r}' AS rule, {r} AS x FROM known" for r in RULES)
    fails = " OR ".join(f"coalesce(f.{r} >= c.{r}.cutoff, false)" for r in RULES)
    count = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    share = lambda a, b: f"coalesce(floor(1000 * {a} / nullif({b}, 0)), 0)::BIGINT"
    return rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, lang, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, {count(SYMBOLS)} AS n_symbols, {count(MARKS)} AS marks_n
  FROM base),
grams AS (
  SELECT rid, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g FROM (SELECT rid, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM w)),
twice AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
rep AS (
  SELECT rid, count(DISTINCT i + d) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) v(d) GROUP BY rid),
f0 AS (
  SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, marks_n
  FROM w LEFT JOIN rep USING (rid)),
f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {share("n_symbols", "word_chars")} AS symbols, {share("n_repeat_words", "n_words")} AS repeats, {share("n_dup_lines", "n_lines")} AS dup_lines,
    {share("marks_n", "word_chars")} AS marks
  FROM f0),
quality AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT f.*, quality.quality FROM f JOIN quality USING (doc_id) WHERE NOT base_failed),
tests AS (
  SELECT lang, rule, cutoff, count(*) FILTER (quality > 0) AS n, count(*) FILTER (quality > 0 AND x >= cutoff) AS k, count(*) FILTER (quality <= 0 AND x >= cutoff) AS caught
  FROM ({rules}) CROSS JOIN (VALUES {cuts}) v(cutoff) GROUP BY ALL),
tails AS (
  SELECT *, CASE WHEN k <= n * {p!r} THEN list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) ELSE 1.0 END AS tail,
    count(*) OVER () AS n_tests
  FROM tests),
cutoffs AS (
  SELECT lang,
{pick}
  FROM tails WHERE tail <= {DELTA!r} / n_tests AND caught > k GROUP BY lang)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept
FROM f LEFT JOIN cutoffs c ON f.lang IS NOT DISTINCT FROM c.lang"""
