"""Maps from variants of names to one name each: tickers, suffixes, likeness."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from . import canon
from .lineage import cut


def frequency(t: DataFrame) -> DataFrame:
    """name, freq and commonest type of the ends of triplets."""
    ends = F.explode(F.array(*(F.struct(F.col(c).alias("name"), F.col(f"{c}_type").alias("type")) for c in ("sub", "obj"))))
    counts = t.select(ends.alias("x")).groupBy("x.name", "x.type").agg(F.count("*").alias("n"))
    return counts.groupBy("name").agg(F.sum("n").alias("freq"), F.min_by("type", F.struct(-F.col("n"), "type")).alias("type"))


def degree_frequency(nodes: DataFrame) -> DataFrame:
    """name, freq over snapshots by degree, at least 1 for each."""
    return nodes.groupBy(F.col("node").alias("name")).agg(F.sum(F.greatest(F.lit(1), F.coalesce("degree", F.lit(1)))).alias("freq"))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"[-\s]", "")


def _forms(tickers: Column) -> Column:
    """Each ticker, without its exchange's suffix, and without hyphens and spaces."""
    cored = F.array_union(tickers, F.transform(tickers, text.exchange_core))
    return F.array_union(cored, F.transform(cored, _squeezed))


def ticker_aliases(names: DataFrame, companies: DataFrame) -> DataFrame:
    """name -> canonical for names (name, type) that are symbols of a company.

    ``companies`` has ord, ticker and company; of companies with one symbol the
    first has it.  Decorations such as LSE:AZN or AZN.L are seen through, the
    longest form wins, and forms of under three characters count for tickers only.
    """
    t = F.upper("ticker")
    core = text.exchange_core(t)
    alias = companies.select("ord", "company", F.explode(F.array_distinct(F.array(t, core, _squeezed(core)))).alias("form"))
    alias = alias.groupBy("form").agg(F.min_by("company", F.struct("ord", "company")).alias("company"))
    u = F.upper(F.trim("name"))
    parts = F.when(u.contains(":"), F.array(u, F.substring_index(u, ":", 1), F.regexp_replace(u, r"^[^:]*:", ""))).otherwise(F.array(u))
    forms = names.filter((F.length(u) <= 16) & (u == F.trim("name"))).select("name", "type", F.explode(_forms(parts)).alias("form"))
    hits = forms.join(alias, "form").filter("name <> company").filter((F.length("form") >= 3) | F.col("type").isin(*vocab.TICKER_TYPES))
    return hits.groupBy("name").agg(F.min_by("company", F.struct(-F.length("form"), "form")).alias("canonical"))


def suffix_merge(names: DataFrame) -> DataFrame:
    """name -> canonical for names (name, freq, type) that differ by case, articles,
    hyphens and legal endings only; the commonest stands, ties by name.

    Names that are all the key itself merge within a type; keys of two letters
    merge only where each member begins with the key and some has an ending.
    """
    low = F.lower(F.trim("name"))
    keyed = names.withColumn("key", text.suffix_key(F.col("name"))).filter(F.length("key") >= 2)
    whole = keyed.groupBy("key").agg(F.max((low != F.col("key")).cast("int")).alias("_away"), F.min(low.startswith(F.col("key")).cast("int")).alias("_begins"))
    keyed = keyed.join(whole, "key").filter((F.length("key") > 2) | ((F.col("_away") == 1) & (F.col("_begins") == 1)))
    keyed = keyed.withColumn("_type", F.when(F.col("_away") == 0, F.coalesce("type", F.lit("UNK"))).otherwise(""))
    best = keyed.groupBy("key", "_type").agg(F.min_by("name", F.struct(-F.col("freq"), "name")).alias("canonical"))
    return keyed.join(best, ["key", "_type"]).filter("name <> canonical").select("name", "canonical")


def shares_merge(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping`` with "X Shares" and "X Stock" merged into what X is merged into."""
    base = F.lower(F.regexp_extract(F.trim("name"), r"(?i)^(.+?)\s+(?:shares?|stock)$", 1))
    some = names.join(mapping.select("name"), "name", "left_anti").select("name", base.alias("base")).filter("base <> ''")
    known = names.groupBy(F.lower(F.trim("name")).alias("base")).agg(F.max("name").alias("_to"))
    onward = mapping.select(F.col("name").alias("_to"), F.col("canonical").alias("_on"))
    new = some.join(known, "base").filter("name <> _to").join(onward, "_to", "left")
    return mapping.unionByName(new.select("name", F.coalesce("_on", "_to").alias("canonical")))


def likeness_merge(names: DataFrame, least: float = 0.8) -> DataFrame:
    """name -> canonical for names (name, freq, type) of one type that are alike,
    directly or through others; the commonest, then the longest stands."""
    kind = lambda c: names.select(F.col("name").alias(c), F.col("type").alias(f"_{c}"))
    pairs = canon.similar_pairs(names.select("name"), least).join(kind("name"), "name").join(kind("other"), "other").filter("_name <=> _other")
    links = cut(pairs.select(F.col("name").alias("a"), F.col("other").alias("b")))
    if not links.limit(1).count():
        return names.sparkSession.createDataFrame([], "name string, canonical string")
    members = canon.components(links).withColumnRenamed("node", "name").join(names, "name")
    best = members.groupBy("root").agg(F.min_by("name", F.struct(-F.col("freq"), -F.length("name"), "name")).alias("canonical"))
    return members.join(best, "root").filter("name <> canonical").select("name", "canonical")


def through(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """Names with their frequencies after a map; types are those of the new name."""
    moved = names.join(mapping, "name", "left").groupBy(F.coalesce("canonical", "name").alias("name")).agg(F.sum("freq").alias("freq"))
    return moved.join(names.select("name", "type"), "name", "left").withColumn("type", F.coalesce("type", F.lit("UNK")))


def clean_map(names: DataFrame, companies: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    """name -> canonical through tickers, suffixes and likeness in turn, with
    frequencies counted again between; junk names take no part."""
    kept = cut(names.filter(~text.is_junk(F.col("name"))))
    none = names.sparkSession.createDataFrame([], "name string, canonical string")
    tickers = cut(ticker_aliases(kept, companies)) if companies is not None else none
    second = cut(through(kept, tickers))
    suffixes = cut(shares_merge(second, suffix_merge(second)))
    alike = likeness_merge(through(second, suffixes), least)
    out = kept.select("name", F.col("name").alias("_now"))
    for step in (tickers, suffixes, alike):
        out = out.join(step.select(F.col("name").alias("_now"), F.col("canonical").alias("_next")), "_now", "left").select("name", F.coalesce("_next", "_now").alias("_now"))
    return out.filter("name <> _now").select("name", F.col("_now").alias("canonical"))


def _alike_labels(labels: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of labels (label, low) with an LCS ratio of at least ``least``.

    Two such labels share one of the rarest bigrams of each: an inserted or
    dropped character spoils at most two, and the ratio bounds how many there are.
    """
    share = 1 - (least - 0.5) / 100
    size = F.length("low")
    grams = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.col("low").substr(i, F.lit(2)))
    each = labels.filter(size >= 2).select("label", "low", F.explode(F.array_distinct(grams)).alias("gram"))
    df = each.groupBy("gram").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("df", "gram"))
    # Characters that differ are at most 2 * share / (1 - share) of either label's own length.
    prefix = 2 * F.floor(size * (2 * share / (1 - share)) + 1e-9) + 1
    index = each.join(df, "gram").withColumn("_rank", rank).filter(F.col("_rank") <= prefix).select("label", "low", "gram")
    other = index.select(F.col("label").alias("other"), F.col("low").alias("low2"), "gram")
    close = 100 * 2 * F.least(F.length("low"), F.length("low2")) >= (least - 0.5) * (F.length("low") + F.length("low2"))
    pairs = index.join(other, "gram").filter(close & (F.col("label") < F.col("other"))).select("label", "other", "low", "low2").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [canon.lcs_ratio(a, b) >= least for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(verify, "label string, other string")


def relation_merge(freq: DataFrame, least: int = 92) -> DataFrame:
    """name -> canonical for relation labels (rel, n): those that differ by case
    take the commonest, and of these, from the commonest on, each takes later ones
    that are alike and not yet taken."""
    low = F.lower(F.trim("rel"))
    best = freq.groupBy(low.alias("low")).agg(F.min_by("rel", F.struct(-F.col("n"), "rel")).alias("label"), F.max("n").alias("n"))
    cases = freq.join(best, low == F.col("low")).filter("rel <> label").select(F.col("rel").alias("name"), F.col("label").alias("canonical"))
    best = cut(best)
    order = best.select("label", F.struct(-F.col("n"), F.col("label")).alias("at"))
    pairs = _alike_labels(best, least)
    both = pairs.unionByName(pairs.select(F.col("other").alias("label"), F.col("label").alias("other")))
    both = both.join(order, "label").join(order.select(F.col("label").alias("other"), F.col("at").alias("at2")), "other")
    earlier = cut(both.filter("at2 < at").select("label", "other", "at2"))
    # A label stays if every earlier one that is like it is taken, and is taken if one of these stays.
    state = cut(earlier.select("label").union(earlier.select("other")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while state.filter("kept is null").limit(1).count():
        seen = earlier.join(state.withColumnRenamed("label", "other").withColumnRenamed("kept", "_k"), "other")
        seen = seen.groupBy("label").agg(F.max(F.coalesce("_k", F.lit(False))).alias("_taken"), F.min(F.coalesce(~F.col("_k"), F.lit(False))).alias("_free"))
        verdict = F.when(F.col("_taken"), False).when(F.coalesce("_free", F.lit(True)), True)
        state = cut(state.join(seen, "label", "left").select("label", F.coalesce("kept", verdict).alias("kept")))
    stays = state.filter("kept").select(F.col("label").alias("other"))
    taken = earlier.join(state.filter("not kept").select("label"), "label", "left_semi").join(stays, "other", "left_semi")
    alike = taken.groupBy("label").agg(F.min_by("other", "at2").alias("canonical")).withColumnRenamed("label", "name")
    return cases.unionByName(alike)
