"""Canonical names, relations and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .lineage import broadcast_if_small, cut, dealt


def suffix_map(names: DataFrame) -> DataFrame:
    """name -> canonical: of names with one suffix key the commonest, then the
    shortest, then the first."""
    keyed = names.withColumn("key", text.suffix_key(F.col("name"))).filter("key <> ''")
    best = keyed.groupBy("key").agg(F.min_by("name", F.struct(-F.col("freq"), F.length("name"), "name")).alias("canonical"))
    return keyed.join(best, "key").select("name", "canonical", "key")


def rename(t: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """``columns`` through a name -> canonical map, others as they are."""
    for c in columns:
        m = mapping.select(F.col("name").alias(c), F.col("canonical").alias("_to"))
        t = t.join(m, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return t


def lcs_ratio(a: str, b: str) -> int:
    """100 * 2 * LCS / (len a + len b), rounded."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return round(200 * row[-1] / (len(a) + len(b))) if a or b else 100


def char_grams(name: str = "name") -> Column:
    """Character 2- to 4-grams of the lower-cased words, each padded by a space; a
    padded word no longer than n gives its whole text once and no longer grams."""
    words = F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")
    none = F.array().cast("array<string>")

    def grams(w: Column) -> Column:
        slide = lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: w.substr(i, F.lit(n)))
        return F.concat(slide(2), *(F.when(F.length(w) >= n, slide(n)).otherwise(none) for n in (3, 4)))

    return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), grams))


#: Grams of a name, about; a task spreads so many fewer names.
GRAMS_A_NAME = 50


def tfidf(names: DataFrame) -> DataFrame:
    """name, gram, df, weight: raw counts times ln((1 + n) / (1 + df)) + 1, to length 1."""
    names = cut(names.select("name"))
    n = names.count()
    # Names are small beside their grams, so they are dealt before they are spread.
    spread = dealt(names, n * GRAMS_A_NAME, "name").select("name", F.explode(char_grams()).alias("gram"))
    counts = cut(spread.groupBy("name", "gram").agg(F.count("*").alias("tf")))
    df = cut(counts.groupBy("gram").agg(F.count("*").alias("df")))
    w = counts.join(broadcast_if_small(df, 1_000_000), "gram").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    length = w.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, "name").select("name", "gram", "df", (F.col("w") / F.col("length")).alias("weight"))


def _may_reach(least: float) -> Column:
    """Whether a pair whose first common gram this is may have the cosine: the product
    of its weights, and of what follows at most the lengths' product, and at most
    the one's sum times the other's largest weight."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    after = F.least(a("rest") * b("rest"), a("sum") * b("most"), b("sum") * a("most"))
    return a("weight") * b("weight") + after >= least - 1e-9


def similar_pairs(names: DataFrame, least: float = 0.8, block: int = 2000) -> DataFrame:
    """Pairs of names with a cosine of at least ``least``, that share a word of
    over two letters where both have one, and have the same digits.

    Exact.  A name's grams are ordered by document frequency.  Indexed are those
    before which a name's weights leave enough for the bound, so frequent grams
    seldom are.  Names meet by a gram and their digits, and an index of both is dealt
    over blocks of about ``block`` names, whose pairs are tasks' keys, so a gram that
    many names share is no straggler.  Pairs that meet are dropped where no cosine of
    that size can follow; for the others each name's vector comes along as one row.
    """
    v = cut(tfidf(names))
    ordered = Window.partitionBy("name").orderBy("df", "gram")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    left = lambda w: F.sqrt(F.greatest(F.lit(0.0), w))
    none = lambda c: F.coalesce(c, F.lit(0.0))
    square = F.col("weight") * F.col("weight")
    index = v.withColumns({
        "open": left(1 - none(F.sum(square).over(before))), "rest": left(none(F.sum(square).over(after))),
        "sum": none(F.sum("weight").over(after)), "most": none(F.max("weight").over(after)),
    }).filter(F.col("open") >= least - 1e-9).select("name", "gram", "weight", "rest", "sum", "most")
    index = cut(index.withColumn("digits", F.array_join(F.regexp_extract_all("name", F.lit(r"(\d+)")), ",")))
    hot = cut(index.groupBy("gram", "digits").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1"))
    blocked = index.join(broadcast_if_small(hot, 1_000_000), ["gram", "digits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own, last = F.pmod(F.xxhash64("name"), F.col("blocks")), F.col("blocks") - 1
    zero = F.lit(0).cast("long")
    rows = blocked.withColumn("x", own).withColumn("y", F.explode(F.sequence("x", last)))
    others = blocked.withColumn("y", own).withColumn("x", F.explode(F.sequence(zero, F.col("y"))))
    met = rows.alias("a").join(others.alias("b"), ["gram", "digits", "x", "y"]).filter((F.col("x") < F.col("y")) | (F.col("a.name") < F.col("b.name"))).filter(_may_reach(least))
    pairs = met.select(F.least("a.name", "b.name").alias("name"), F.greatest("a.name", "b.name").alias("other")).distinct()
    vectors = v.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("gram", "weight"))).alias("v"))
    both = pairs.join(vectors, "name").join(vectors.select(F.col("name").alias("other"), F.col("v").alias("w")), "other")
    dot = F.aggregate(F.map_entries("v"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("w", e["key"]), F.lit(0.0)))
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 2)
    share = (F.size(words("name")) == 0) | (F.size(words("other")) == 0) | F.arrays_overlap(words("name"), words("other"))
    return both.filter(share).select("name", "other", dot.alias("cosine")).filter(F.col("cosine") >= least)


def dedupe_triplets(t: DataFrame) -> DataFrame:
    """The first of equal (sub, rel, obj) within an article."""
    first = Window.partitionBy("url", "sub", "rel", "obj").orderBy("seq")
    return t.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def min_frequency(t: DataFrame, least: int) -> DataFrame:
    freq = t.select(F.explode(F.array("sub", "obj")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    for end in ("sub", "obj"):
        t = t.join(freq.select(F.col("node").alias(end)), end, "left_semi")
    return t


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node -> smallest node of its component, for links (a, b), by label spreading
    with pointer jumping; each round is cut by a checkpoint."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    now = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        heard = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        near = now.join(heard, "node").select("node", F.least("root", "heard").alias("r"), F.col("root").alias("old"))
        jump = cut(near.join(near.select(F.col("node").alias("r"), F.col("r").alias("far")), "r", "left").select("node", F.least("r", F.coalesce("far", "r")).alias("root"), "old"))
        if not jump.filter("root <> old").limit(1).count():
            return jump.select("node", "root")
        now = jump.select("node", "root")
    raise RuntimeError("components did not settle")


def sector_of(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """The first sector, in order, of which a keyword stands in the name as whole words.

    Names are spread into runs of as many words as keywords have and joined by equality.
    """
    split = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9&]+"), lambda x: x != "")
    rows = cut(keywords.select("sector", "ord", F.array_join(split("keyword"), " ").alias("run"), F.size(split("keyword")).alias("size")).filter("size > 0"))
    sizes = [r["size"] for r in rows.select("size").distinct().collect()]  # the few lengths of keywords
    w = nodes.select("node", split("node").alias("w"))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.array_join(F.slice("w", i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    spread = w.select("node", F.explode(F.array_distinct(F.flatten(F.array(*(runs(n) for n in sizes))))).alias("run")) if sizes else w.select("node", F.lit("").alias("run"))
    return spread.join(broadcast_if_small(rows, 100_000), "run").groupBy("node").agg(F.min_by("sector", "ord").alias("sector"))


def sector_vote(members: DataFrame, sectors: DataFrame, order: DataFrame) -> DataFrame:
    """Each component's commonest sector, ties by the configured order."""
    votes = members.join(sectors, "node").groupBy("root", "sector").agg(F.count("*").alias("n")).join(order, "sector")
    best = votes.groupBy("root").agg(F.min_by("sector", F.struct(-F.col("n"), "ord")).alias("sector"))
    return members.join(best, "root", "left").select("node", "root", F.coalesce("sector", F.lit("Other")).alias("sector"))
