"""Activity trends and link-prediction leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from .lineage import broadcast_if_small, cut


def activity(t: DataFrame) -> DataFrame:
    """Rows by entity and period; a row with the entity at both ends counts once."""
    return t.select("month", "url", "seq", F.explode(F.array_distinct(F.array("sub", "obj"))).alias("entity")).groupBy("entity", "month").agg(F.count("*").alias("n"))


def periods(t: DataFrame) -> DataFrame:
    """Existing months numbered in turn: gaps are skipped."""
    return t.select("month").distinct().withColumn("p", F.row_number().over(Window.orderBy("month")).cast("long"))


def raw_novelty(t: DataFrame, month: str) -> DataFrame:
    """Count of the last three periods, and it less the mean of those before."""
    p = cut(periods(t))
    at = p.filter(F.col("month") == month).select(F.col("p").alias("at"))
    a = activity(t).join(F.broadcast(p), "month").crossJoin(F.broadcast(at)).filter("p <= at")  # rows for months, one row
    recent = F.sum(F.when(F.col("p") > F.col("at") - 3, F.col("n")).otherwise(0))
    before = F.sum(F.when(F.col("p") <= F.col("at") - 3, F.col("n")).otherwise(0))
    return a.groupBy("entity").agg(recent.alias("recent"), (recent - F.coalesce(before / F.when(F.max("at") > 3, F.max("at") - 3), F.lit(0.0))).alias("raw"))


def novelty_z(t: DataFrame, month: str) -> DataFrame:
    """Novelty of every entity, standardised among all."""
    raw = cut(raw_novelty(t, month))
    stats = raw.agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("s"))
    return raw.crossJoin(F.broadcast(stats)).select("entity", "recent", F.when(F.col("s") < 1e-6, 0.0).otherwise((F.col("raw") - F.col("m")) / F.col("s")).alias("z"))


def trend(t: DataFrame, month: str) -> DataFrame:
    """Counts of the last three periods, padded with zeros on the left."""
    p = cut(periods(t))
    at = p.filter(F.col("month") == month).select(F.col("p").alias("at"))
    a = activity(t).join(F.broadcast(p), "month").crossJoin(F.broadcast(at)).filter("p between at - 2 and at")
    return a.groupBy("entity").agg(*(F.sum(F.when(F.col("p") == F.col("at") - k, F.col("n")).otherwise(0)).alias(f"t{2 - k}") for k in (2, 1, 0)))


def band(z: Column) -> Column:
    """Activity band of a standardised count."""
    return F.when(F.abs(z) < 1, "Stable").when(F.abs(z) < 2, F.when(z > 0, "Rising").otherwise("Cooling")).otherwise(F.when(z > 0, "Spiking").otherwise("Quiet"))


def importance(nodes: DataFrame, dims: int) -> DataFrame:
    """Mean score against all others of the period, self counted as 0:
    (e·Σe - e·e) / N, without a pair of rows."""
    total = nodes.groupBy("period").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("e")[i]) for i in range(dims))).alias("s"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return nodes.join(total, "period").withColumn("importance", (dot(F.col("e"), F.col("s")) - dot(F.col("e"), F.col("e"))) / F.col("n")).drop("s", "n")


def leaderboard(scored: DataFrame, kinds: list[str], k: int = 40) -> DataFrame:
    """The k most important entities of a period, of the kinds, one for each alias."""
    one = Window.partitionBy("period", "alias").orderBy(F.desc("importance"), "entity")
    rank = Window.partitionBy("period").orderBy(F.desc("importance"), "entity")
    kept = scored.filter(F.col("entity_type").isin(kinds)).withColumn("_a", F.row_number().over(one)).filter("_a = 1")
    return kept.withColumn("rank", F.row_number().over(rank).cast("long")).filter(F.col("rank") <= k).drop("_a")


def comovers(nodes: DataFrame, sources: DataFrame, k: int = 5) -> DataFrame:
    """For each source of a period, the k targets of highest score, one for each
    alias and none with its own; sources are a bounded leaderboard of each period."""
    s = broadcast_if_small(cut(sources.select("period", F.col("entity").alias("source"), F.col("alias").alias("own"), F.col("e").alias("q"))), 100_000)
    dot = F.aggregate(F.zip_with("e", "q", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    pairs = nodes.join(s, "period").filter("alias <> own").select("period", "source", "entity", "alias", dot.alias("score"))
    one = Window.partitionBy("period", "source", "alias").orderBy(F.desc("score"), "entity")
    rank = Window.partitionBy("period", "source").orderBy(F.desc("score"), "entity")
    return pairs.withColumn("_a", F.row_number().over(one)).filter("_a = 1").withColumn("rank", F.row_number().over(rank).cast("long")).filter(F.col("rank") <= k).drop("_a", "alias")


def rank_metrics(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.avg(1 / F.col("rank")).alias("mrr"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"hits{k}") for k in (1, 3, 10)))


def rolling_windows(t: DataFrame, width: int = 3) -> DataFrame:
    """Train months and the test month after them, by position."""
    p = periods(t)
    test = p.filter(F.col("p") > width).select(F.col("month").alias("test_month"), F.col("p").alias("tp"))
    return test.join(F.broadcast(p), (F.col("p") >= F.col("tp") - width) & (F.col("p") < F.col("tp"))).select("test_month", F.col("month").alias("train_month"))


def cooccurrence(t: DataFrame, top: int = 200) -> DataFrame:
    """Presence of the busiest entities by day: triplets' rows that name them are
    one each, divided by the day's largest."""
    each = t.select("day", F.explode(F.array("sub", "obj")).alias("entity"))
    busy = each.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(top).select("entity")
    there = each.join(F.broadcast(busy), "entity", "left_semi").distinct().withColumn("_v", F.lit(1.0))  # top rows
    return there.withColumn("value", F.col("_v") / F.max("_v").over(Window.partitionBy("day"))).drop("_v")  # at most top rows a day


def listed_novelty(t: DataFrame, month: str, listed: DataFrame) -> DataFrame:
    """Novelty of the listed entities, standardised among them; 0 where it does not vary."""
    raw = raw_novelty(t, month)
    x = listed.select("entity").join(raw, "entity", "left").select("entity", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    stats = x.agg(F.avg("raw").alias("m"), F.stddev_pop("raw").alias("s"))  # one row
    return x.crossJoin(F.broadcast(stats)).select("entity", F.when(F.col("s") < 1e-6, 0.0).otherwise((F.col("raw") - F.col("m")) / F.col("s")).alias("novelty_z"))


def period_predictions(nodes: DataFrame, t: DataFrame, month: str, dims: int, entities: int = 40, targets: int = 5) -> DataFrame:
    """One period's leaderboard: rank, entity, type, novelty_z, trend and targets.

    ``nodes`` has the period's entity, entity_type and vector e.  Ranked types and
    names that are no junk are ranked by importance, one for each alias; targets
    are the best scored others of any known type, one for each alias.
    """
    alias = text.alias_key(F.col("entity"))
    named = importance(nodes.withColumn("period", F.lit(month)), dims).withColumn("alias", alias).filter(~text.is_ranked_junk(F.col("entity")) & (F.col("alias") != ""))
    named = cut(named.withColumn("kind", F.upper("entity_type")))
    board = cut(leaderboard(named.withColumn("entity_type", F.col("kind")), list(vocab.RANKED_TYPES), entities))
    goals = comovers(named.filter(F.col("kind").isin(*vocab.TARGET_TYPES)).select("period", "entity", "alias", "e"), board.select("period", "entity", "alias", "e"), targets)
    listed = goals.groupBy(F.col("source").alias("entity")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("targets"))
    novelty, recent = listed_novelty(t, month, board), trend(t, month)
    out = board.select("rank", "entity", "entity_type").join(novelty, "entity").join(recent, "entity", "left").join(listed, "entity", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("rank", "entity", "entity_type", F.round("novelty_z", 3).alias("novelty_z"), F.array(zero("t0"), zero("t1"), zero("t2")).alias("trend"), F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))


def all_predictions(nodes: DataFrame, t: DataFrame, dims: int, entities: int = 40, targets: int = 5) -> DataFrame:
    """The leaderboards of all periods at once: period, total_entities, and what
    ``period_predictions`` gives for each.

    ``nodes`` has period, entity, entity_type and vector e; a period is one of the
    triplets' months, and others are left out.  Activity is joined with the listed
    entities of each period only, so it is not spread over all later periods.
    """
    p = cut(periods(t))
    there = nodes.join(F.broadcast(p.select(F.col("month").alias("period"))), "period", "left_semi")  # rows for months
    totals = there.groupBy("period").agg(F.count("*").alias("total_entities"))
    named = importance(there, dims).withColumn("alias", text.alias_key(F.col("entity"))).filter(~text.is_ranked_junk(F.col("entity")) & (F.col("alias") != ""))
    named = cut(named.withColumn("kind", F.upper("entity_type")))
    board = cut(leaderboard(named.withColumn("entity_type", F.col("kind")), list(vocab.RANKED_TYPES), entities))
    goals = comovers(named.filter(F.col("kind").isin(*vocab.TARGET_TYPES)).select("period", "entity", "alias", "e"), board.select("period", "entity", "alias", "e"), targets)
    listed = goals.groupBy("period", F.col("source").alias("entity")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("targets"))

    at = board.select("period", "entity").join(F.broadcast(p.select(F.col("month").alias("period"), F.col("p").alias("at"))), "period")
    back = F.col("at") - F.col("p")
    acts = at.join(activity(t).join(F.broadcast(p), "month"), "entity").filter(back >= 0)
    some = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    recent, before = some(back < 3), some(back >= 3)
    raw = (recent - F.coalesce(before / F.when(F.max("at") > 3, F.max("at") - 3), F.lit(0.0))).alias("raw")
    counted = acts.groupBy("period", "entity").agg(raw, *(some(back == k).alias(f"t{2 - k}") for k in (2, 1, 0)))
    x = at.join(counted, ["period", "entity"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    whole = Window.partitionBy("period")  # a leaderboard
    x = x.withColumns({"_m": F.avg("raw").over(whole), "_s": F.stddev_pop("raw").over(whole)})
    z = F.when(F.col("_s") < 1e-6, 0.0).otherwise((F.col("raw") - F.col("_m")) / F.col("_s"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    x = x.select("period", "entity", F.round(z, 3).alias("novelty_z"), F.array(zero("t0"), zero("t1"), zero("t2")).alias("trend"))
    out = board.select("period", "rank", "entity", "entity_type").join(x, ["period", "entity"]).join(listed, ["period", "entity"], "left").join(totals, "period")
    return out.select("period", "total_entities", "rank", "entity", "entity_type", "novelty_z", "trend", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
