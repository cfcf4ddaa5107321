"""URL filters by association rules.

Fixed rules judge a url by host and path.  The urls they judge are labels, from
which FP-growth mines combinations of url tokens that imply a verdict.  Tokens
that stand in the same labelled urls are mined as one, any of which will do:
else k of them would give 2^k combinations.  Rules
below the support or confidence wanted are pruned, and so is a rule that a more
general one makes needless.  A url is matched through an inverted index: each
rule stands under its rarest token, is fetched by the urls that have it, and
verified on all its tokens.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, lower_ascii

#: (verdict, host, path) of the fixed rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SUPPORT, CONFIDENCE = 0.01, 0.9
_VERDICT = "verdict="


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (lower case) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.locate("://", F.col(url)) > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)"))
    out = pages.withColumn("_rest", F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit("")))
    host = lower_ascii(F.substring_index("_rest", "/", 1))
    return out.withColumn("host", host).withColumn("path", F.expr("substring(_rest, length(host) + 1)")).drop("_rest")


def fixed_rule(rules: tuple = RULES) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens() -> Column:
    """Distinct tokens of host and path; digit runs are one token, whatever they are."""
    labels = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    plain = F.regexp_replace(lower_ascii(F.col("path")), "[0-9]+", "#")
    parts = F.transform(F.filter(F.split(plain, r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    return F.array_sort(F.array_distinct(F.concat(labels, parts)))


def alike_tokens(baskets: DataFrame, least: int) -> DataFrame:
    """rep, group and freq of tokens that stand in exactly the same of ``baskets``
    (distinct tokens and verdict, n rows), where at least ``least`` rows have them."""
    h = F.xxhash64("tokens", "verdict")
    each = baskets.select(F.explode("tokens").alias("token"), "n", h.alias("h"))
    sums = each.groupBy("token").agg(F.sum("n").alias("freq"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("h").alias("xor"), F.count("*").alias("baskets"))
    # At most 1 / support times the tokens of a url come so far.
    return sums.filter(F.col("freq") >= least).groupBy("freq", "sum", "xor", "baskets").agg(F.min("token").alias("rep"), F.array_sort(F.collect_list("token")).alias("group")).select("rep", "group", "freq")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules from rows with ``tokens`` and ``verdict``: antecedent, verdict,
    confidence, and anchor.  A url fits if it has a token of each group of the
    antecedent; the anchor is the rarest of these.  No rows, no rules."""
    spark = labelled.sparkSession
    n = labelled.count()
    if not n:
        return spark.createDataFrame([], "antecedent array<array<string>>, verdict string, confidence double, anchor array<string>")
    baskets = cut(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "baskets")
    groups = cut(alike_tokens(baskets, math.ceil(support * n)), "groups")
    known = broadcast_if_small(groups, 100_000)
    member = known.select("rep", F.explode("group").alias("token"))
    named = baskets.withColumn("token", F.explode("tokens")).join(member, "token").groupBy("tokens", "verdict").agg(F.collect_set("rep").alias("reps"))
    items = F.concat(F.coalesce("reps", F.array().cast("array<string>")), F.array(F.concat(F.lit(_VERDICT), "verdict"))).alias("items")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.join(named, ["tokens", "verdict"], "left").select(items))
    rules = model.associationRules.filter((F.size("consequent") == 1) & F.col("consequent")[0].startswith(_VERDICT))
    rules = rules.select(F.array_sort("antecedent").alias("reps"), F.substring(F.col("consequent")[0], len(_VERDICT) + 1, 100).alias("verdict"), "confidence")
    own = rules.withColumn("rep", F.explode("reps")).join(known, "rep").groupBy("reps", "verdict", "confidence")
    rules = cut(own.agg(F.collect_list("group").alias("antecedent"), F.min_by("group", F.struct("freq", "rep")).alias("anchor"), F.min_by("rep", F.struct("freq", "rep")).alias("_a")), "rules")
    # A rule is needless if one with a part of its tokens says the same with no less confidence.
    general = rules.select(F.col("reps").alias("part"), F.col("verdict").alias("_v"), F.col("confidence").alias("_c"), "_a")
    covered = (F.size(F.array_except("part", "reps")) == 0) & (F.size("part") < F.size("reps")) & (F.col("_v") == F.col("verdict")) & (F.col("_c") >= F.col("confidence"))
    needless = rules.withColumn("_a", F.explode("reps")).join(general, "_a").filter(covered).select("reps", "verdict").distinct()
    return rules.join(needless, ["reps", "verdict"], "left_anti").select("antecedent", "verdict", "confidence", "anchor")


def match(baskets: DataFrame, rules: DataFrame) -> DataFrame:
    """The verdict for each row of ``baskets`` (tokens, distinct): of the most
    confident rule that fits; block before allow at equal confidence."""
    index = broadcast_if_small(rules, 20_000).withColumn("token", F.explode("anchor"))
    found = baskets.withColumn("token", F.explode("tokens")).join(index, "token")
    fits = found.filter(F.forall("antecedent", lambda group: F.arrays_overlap(group, F.col("tokens"))))
    return fits.groupBy("tokens").agg(F.max_by("verdict", F.struct("confidence", F.col("verdict") == "block")).alias("mined"))


def op5_url_filter(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``; a url that
    neither a fixed nor a mined rule fits is allowed.  An empty table gives an
    empty result."""
    judged = with_parts(pages.select("page_id", F.col("url").cast("string").alias("url"))).withColumn("fixed", fixed_rule()).withColumn("tokens", tokens())
    judged = cut(judged.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.col("fixed.verdict").alias("fixed"), "tokens"), "urls")
    rules = cut(mine(judged.filter("fixed is not null").select("tokens", F.col("fixed").alias("verdict"))), "mined")
    # Urls with the same tokens are matched once.
    verdicts = cut(match(judged.filter("fixed is null").select("tokens").distinct(), rules), "verdicts")
    open_ = judged.filter("fixed is null").join(broadcast_if_small(verdicts, 50_000), "tokens", "left")
    known = judged.filter("fixed is not null").withColumn("mined", F.col("fixed"))
    return known.unionByName(open_).select("page_id", "host", "path", "rule", F.coalesce("fixed", "mined", F.lit("allow")).alias("verdict"))
