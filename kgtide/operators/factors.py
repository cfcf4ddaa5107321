"""Entity factors: attention, sentiment, consensus, novelty, materiality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

FACTORS = ("attention", "sentiment", "consensus", "novelty", "materiality")


def ordered_fold(t: DataFrame, *key: str) -> DataFrame:
    """Per key the pairwise running average of sentiments in triplet order,
    ((s1 + s2) / 2 + s3) / 2 …, which is not their mean."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("seq", "sentiment"))), lambda x: x["sentiment"])
    rows = t.groupBy(*key).agg(values.alias("v"))
    fold = F.aggregate(F.expr("slice(v, 2, size(v))"), F.get("v", F.lit(0)), lambda a, x: (a + x) / 2)
    return rows.withColumn("sentiment", fold).drop("v")


def novelty(t: DataFrame) -> DataFrame:
    """Share of an entity's partners that no other entity has."""
    pairs = t.select("sub", "obj").distinct()
    alone = pairs.groupBy("obj").agg((F.count("*") == 1).cast("int").alias("alone"))
    return pairs.join(alone, "obj").groupBy("sub").agg((F.sum("alone") / F.count("*")).alias("novelty"))


def article_factors(t: DataFrame) -> DataFrame:
    """Factors by entity from triplets; consensus is over per-article sentiments."""
    per = ordered_fold(t, "url", "sub").groupBy("sub").agg(
        F.count("*").alias("attention"), F.avg("sentiment").alias("sentiment"),
        F.when(F.count("*") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop("sentiment"))).alias("consensus"),
    )
    usd = t.groupBy("sub").agg(F.log1p(F.coalesce(F.sum(F.when(F.col("materiality_usd") > 0, F.col("materiality_usd"))), F.lit(0)).cast("double")).alias("materiality"))
    return per.join(usd, "sub").join(novelty(t), "sub")


def snapshot_factors(e: DataFrame) -> DataFrame:
    """Factors by entity from edges: sentiment weighs by edge weight, consensus doesn't."""
    w = F.when(F.coalesce("weight", F.lit(0)) == 0, 1).otherwise(F.col("weight"))
    has = F.col("sentiment").isNotNull()
    agg = e.groupBy("sub").agg(
        F.sum(w).alias("attention"),
        F.coalesce(F.sum(F.when(has, F.col("sentiment") * w)) / F.sum(F.when(has, w)), F.lit(0.0)).alias("sentiment"),
        F.when(F.count(F.when(has, 1)) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop("sentiment"))).alias("consensus"),
        F.log1p(F.sum(F.greatest(F.lit(0.0), F.coalesce("materiality_usd", F.lit(0.0))))).alias("materiality"),
    )
    return agg.join(novelty(e), "sub")


def event_mix(e: DataFrame, k: int = 5, order: str | None = None) -> DataFrame:
    """The k commonest events of each entity, ties by name, or by first sight in ``order``."""
    tie = F.min(order) if order else F.first("event_type")
    counted = e.groupBy("sub", "event_type").agg(F.sum(F.col("weight").cast("long")).alias("n"), tie.alias("_tie"))
    rn = F.row_number().over(Window.partitionBy("sub").orderBy(F.desc("n"), "_tie"))
    return counted.withColumn("rn", rn).filter(F.col("rn") <= k).select("sub", "event_type", "n", F.col("rn").cast("long").alias("rn"))


def preview_factors(t: DataFrame) -> DataFrame:
    """First-pass factors from triplets alone: sentiment over all triplets, consensus
    over each article's last sentiment, momentum 0, and how many event types there are."""
    last = t.groupBy("sub", "url").agg(F.max_by("sentiment", "seq").alias("s"))
    per = last.groupBy("sub").agg(F.count("*").alias("attention"), F.when(F.count("s") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_pop("s"))).alias("consensus"))
    usd = F.coalesce(F.sum(F.when(F.col("materiality_usd") > 0, F.col("materiality_usd"))), F.lit(0)).cast("double")
    whole = t.groupBy("sub").agg(F.lit(0.0).alias("momentum"), F.coalesce(F.avg("sentiment"), F.lit(0.0)).alias("sentiment"), F.log1p(usd).alias("materiality"), F.count_distinct("event_type").alias("event_diversity"))
    return per.join(whole, "sub").join(novelty(t), "sub")


def top_partners(t: DataFrame, k: int = 10) -> DataFrame:
    return t.groupBy("sub").agg(F.concat_ws("|", F.slice(F.array_sort(F.collect_set("obj")), 1, k)).alias("partners"))


def standardise(f: DataFrame, columns: list[str], least_articles: int = 2, least_entities: int = 4) -> tuple[DataFrame, list[str]]:
    """Entities with enough mentions and their columns standardised by the
    population's deviation; columns without variance are dropped.  With too few
    such entities all are kept.  ``f`` is written once, a row for each entity."""
    f = cut(f)
    some = f.filter(F.col("attention") >= least_articles)
    if some.limit(least_entities).count() < least_entities:
        some = f
    stats = some.agg(*(x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
    kept = [c for c in columns if stats[f"s_{c}"] is not None and stats[f"s_{c}"] > 1e-9]
    return some.select("sub", "attention", *((F.col(c) - stats[f"m_{c}"]).__truediv__(stats[f"s_{c}"]).alias(f"z_{c}") for c in kept)), kept
