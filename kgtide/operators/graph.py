"""Property graphs by month: edges, nodes, degrees, merges and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .lineage import cut


def _order() -> Column:
    """Place of a triplet in the corpus, for order-sensitive rules."""
    return F.struct("url", "seq")


def clean(t: DataFrame, drop_unknown: bool = False, drop_loops: bool = False) -> DataFrame:
    """Triplets with normalised ends and relation; empty ones go."""
    out = t.withColumns({c: text.norm(F.col(c), "") for c in ("sub", "rel", "obj")}).filter("sub <> '' and rel <> '' and obj <> ''")
    if drop_unknown:
        out = out.filter("sub <> 'UNK' and obj <> 'UNK'")
    return out.filter("sub <> obj") if drop_loops else out


def month_edges(t: DataFrame) -> DataFrame:
    return t.groupBy("month", "sub", "obj", "rel", "rel_category").agg(F.count("*").alias("weight"))


def enriched_edges(t: DataFrame, *by: str) -> DataFrame:
    """Edges by (sub, rel, obj); the category of the last occurrence stands."""
    key = [*by, "month", "sub", "rel", "obj"]
    usd = F.sum(F.when(F.col("materiality_usd") > 0, F.col("materiality_usd")))
    each = t.groupBy(*key, "event_type").agg(
        F.count("*").alias("n"), F.min(_order()).alias("first"), F.sum("sentiment").alias("s"), F.count("sentiment").alias("c"), usd.alias("usd"),
        F.max(F.struct(_order().alias("at"), "rel_category")).alias("last"),
    )
    agg = each.groupBy(*key).agg(
        F.sum("n").alias("weight"), (F.sum("s") / F.sum("c")).alias("_s"), F.coalesce(F.sum("usd"), F.lit(0)).cast("double").alias("materiality_usd"),
        F.max("last")["rel_category"].alias("rel_category"), F.min_by("event_type", F.struct(-F.col("n"), "first")).alias("event_type"),
    )
    return agg.withColumns({"sentiment": F.round("_s", 4), "materiality_log": F.round(F.log1p("materiality_usd"), 4), "polarity": text.sentiment_polarity(F.round("_s", 6))}).drop("_s")


def ends(e: DataFrame, *keep: str) -> DataFrame:
    """Both ends of each edge as rows (node, weight)."""
    both = F.explode(F.array(F.col("sub"), F.col("obj"))).alias("node")
    return e.select(*keep, both, "weight")


def weighted_degree(e: DataFrame, *by: str) -> DataFrame:
    """In plus out weight; a self-loop counts twice."""
    return ends(e, *by).groupBy(*by, "node").agg(F.sum("weight").alias("degree"))


def distinct_degree(e: DataFrame, *by: str) -> DataFrame:
    """Distinct out-neighbours plus distinct in-neighbours."""
    pairs = e.select(*by, "sub", "obj").distinct()
    return pairs.select(*by, F.explode(F.array("sub", "obj")).alias("node")).groupBy(*by, "node").agg(F.count("*").alias("degree"))


def occurrences(t: DataFrame, *keep: str, kind: Callable[[Column], Column] = text.entity_type) -> DataFrame:
    """Typed ends in reading order, the subject of a triplet first."""
    one = lambda name, raw, side: F.struct(F.col(name).alias("node"), kind(F.col(raw)).alias("type"), F.lit(side).alias("side"))
    return t.select(*keep, "url", "seq", F.explode(F.array(one("sub", "sub_type", 0), one("obj", "obj_type", 1))).alias("x")).select(*keep, "url", "seq", "x.*")


def node_types(t: DataFrame, variant: str, *by: str, kind: Callable[[Column], Column] = text.entity_type) -> DataFrame:
    """first_known, first, last or majority type of each node."""
    at = F.struct("url", "seq", "side")
    o = occurrences(t, *by, kind=kind)
    if variant == "majority":
        counted = o.groupBy(*by, "node", "type").agg(F.count("*").alias("n"), F.min(at).alias("first"))
        return counted.groupBy(*by, "node").agg(F.min_by("type", F.struct(-F.col("n"), "first")).alias("type"))
    pick = {"first_known": F.min_by("type", F.struct(F.col("type") == "UNK", at)), "first": F.min_by("type", at), "last": F.max_by("type", at)}
    return o.groupBy(*by, "node").agg(pick[variant].alias("type"))


def range_merge(e: DataFrame, first: str, last: str) -> DataFrame:
    """Edges of a month range merged; bounds in either order."""
    lo, hi = min(first, last), max(first, last)
    some = e.filter(F.col("month").between(lo, hi))
    return some.groupBy("sub", "obj", "rel", "rel_category").agg(F.sum("weight").alias("weight"), F.min("month").alias("first_month"), F.count_distinct("month").alias("n_months"))


def positions(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``pos``, the place from 0 in the order given.

    Rows are sorted by range and written; partitions are then counted and their
    offsets joined back, so no task orders the whole table.
    """
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    sorted_ = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", place))
    counts = sorted_.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")  # a row for each partition
    return sorted_.join(before, "_p").withColumn("pos", F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def with_ids(e: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Ids in the order given."""
    return positions(e, *order).withColumn("id", F.concat(F.lit(prefix), F.col("pos").cast("string"))).drop("pos")


def first_seen_ids(t: DataFrame) -> DataFrame:
    """A month's edges with ids in the order in which they are first seen."""
    e = t.groupBy("month", "sub", "obj", "rel", "rel_category").agg(F.count("*").alias("weight"), F.min(_order()).alias("_first"))
    placed = positions(e, "month", "_first")
    begin = placed.groupBy("month").agg(F.min("pos").alias("_begin"))
    return placed.join(begin, "month").withColumn("id", F.concat(F.lit("e"), (F.col("pos") - F.col("_begin")).cast("string"))).drop("pos", "_begin", "_first")


def merge_full(e: DataFrame) -> DataFrame:
    """Monthly edges as one graph: weights add, the strongest score stands, news
    anywhere makes it news, and other attributes are those of the first month."""
    at = F.struct("month")
    return e.groupBy("sub", "obj", "rel", "rel_category").agg(
        F.sum("weight").alias("weight"), F.max("score").alias("score"),
        F.when(F.max((F.coalesce("origin", F.lit("news")) == "news").cast("int")) == 1, F.lit("news")).otherwise(F.min_by("origin", at)).alias("origin"),
        F.min_by("polarity", at).alias("polarity"), F.coalesce(F.min_by("causal_type", at), F.lit("OTHER")).alias("causal_type"),
    )


def graph_stats(e: DataFrame) -> DataFrame:
    """Nodes, edges and edges with a score of one graph."""
    nodes = e.select(F.explode(F.array("sub", "obj")).alias("node")).agg(F.count_distinct("node").alias("nodes"))  # one row
    return e.agg(F.count("*").alias("edges"), F.count("score").alias("scored_edges")).crossJoin(F.broadcast(nodes))


def node_merge(prior: DataFrame, fresh: DataFrame, *by: str) -> DataFrame:
    """Nodes of a month with fresh ones: those there before stay as they are."""
    return insert_if_absent(prior, fresh, *by, "node")


def visible_nodes(n: DataFrame, types: list[str], least: int, sectors: list[str] | None = None) -> DataFrame:
    """Nodes of the types and sectors with at least the degree."""
    out = n.filter(F.col("type").isin(types) & (F.col("degree") >= least))
    return out.filter(F.col("sector").isin(sectors)) if sectors is not None else out


def with_end_types(e: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with the types of their ends, UNK where there is none."""
    for end in ("sub", "obj"):
        e = e.join(types.select(F.col("node").alias(end), F.col("type").alias(f"_{end}")), end, "left").withColumn(f"{end}_type", F.coalesce(f"_{end}", F.lit("UNK"))).drop(f"_{end}")
    return e


def pair_merge(prior: DataFrame, fresh: DataFrame, *by: str) -> DataFrame:
    """A month's graph with a fresh one merged in: weights add, sentiments are
    averaged pairwise, the larger materiality stands."""
    key = [*by, "sub", "rel", "obj"]
    f = fresh.select(*key, F.col("weight").alias("w2"), F.col("sentiment").alias("s2"), F.col("materiality_usd").alias("m2"))
    j = prior.select(*key, "weight", "sentiment", "materiality_usd").join(f, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(
        *key, (zero("weight") + zero("w2")).alias("weight"),
        F.round(F.when(F.col("weight").isNotNull() & F.col("w2").isNotNull(), (F.col("sentiment") + F.col("s2")) / 2).otherwise(F.coalesce("sentiment", "s2")), 4).alias("sentiment"),
        F.greatest("materiality_usd", "m2").alias("materiality_usd"),
    )


def pair_fold(e: DataFrame, at: str, *by: str) -> DataFrame:
    """What ``pair_merge`` leaves of graphs that are merged one by one in the order of
    ``at``.  Ends or relations that are null are nobody's equal, as in its join."""
    key = [*by, "sub", "rel", "obj"]
    alone = F.when(F.concat(*(F.col(c) for c in key)).isNull(), F.col(at))
    one = F.struct(F.col(at).alias("at"), "weight", "sentiment", "materiality_usd")
    listed = e.groupBy(*key, alone.alias("_alone")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    rounded = lambda c: F.round(c, 4)

    def step(a: Column, b: Column) -> Column:
        both = F.when(b["weight"].isNotNull(), (a["sentiment"] + b["sentiment"]) / 2).otherwise(F.coalesce(a["sentiment"], b["sentiment"]))
        return F.struct(
            (a["weight"] + F.coalesce(b["weight"], F.lit(0))).alias("weight"), rounded(both).alias("sentiment"), F.greatest(a["materiality_usd"], b["materiality_usd"]).alias("materiality_usd"),
        )

    first = F.struct(F.coalesce(F.col("x")[0]["weight"], F.lit(0).cast("long")).alias("weight"), rounded(F.col("x")[0]["sentiment"]).alias("sentiment"), F.col("x")[0]["materiality_usd"].alias("materiality_usd"))
    rest = F.slice("x", F.lit(2), F.size("x"))
    return listed.select(*key, F.aggregate(rest, first, step).alias("x")).select(*key, "x.*")


def corpus_upsert(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edge weights of a corpus after new occurrences: they add."""
    key = ["month", "sub", "obj", "rel", "rel_category"]
    return prior.unionByName(month_edges(fresh)).groupBy(*key).agg(F.sum("weight").alias("weight"))


def insert_if_absent(store: DataFrame, fresh: DataFrame, *key: str) -> DataFrame:
    """``store`` with the rows of ``fresh`` whose key it lacks, each key once."""
    return store.unionByName(fresh.dropDuplicates([*key]).join(store, [*key], "left_anti"), allowMissingColumns=True)


def snapshot_stats(e: DataFrame) -> DataFrame:
    nodes = ends(e, "month").groupBy("month").agg(F.count_distinct("node").alias("nodes"))
    return e.groupBy("month").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")).join(nodes, "month")


def index_months(e: DataFrame, current: str, least: int = 3) -> DataFrame:
    """Months with at least ``least`` edges, and the current one."""
    return e.groupBy("month").agg(F.count("*").alias("n")).filter((F.col("n") >= least) | (F.col("month") == current))


def top_graph(e: DataFrame, n_nodes: int = 40, n_edges: int = 200) -> DataFrame:
    """The busiest nodes of a snapshot and the heaviest edges among them."""
    top = weighted_degree(e).orderBy(F.desc("degree"), "node").limit(n_nodes)
    for end in ("sub", "obj"):
        e = e.join(F.broadcast(top.select(F.col("node").alias(end))), end, "left_semi")  # n_nodes rows
    return e.orderBy(F.desc("weight"), "sub", "obj", "rel", "rel_category").limit(n_edges)


def min_degree(d: DataFrame, percent: float) -> DataFrame:
    """Nodes at or above the share of the largest degree, which is at least 1."""
    top = d.agg(F.greatest(F.lit(1), F.floor(F.lit(percent) / 100 * F.max("degree") + 0.5)).alias("_least"))  # one row
    return d.crossJoin(F.broadcast(top)).filter("degree >= _least").drop("_least")


def auto_threshold(d: DataFrame) -> DataFrame:
    """Percent of the largest degree that leaves about 300 nodes; 5 for small graphs."""
    at = d.orderBy(F.desc("degree")).limit(300).agg(F.min("degree").alias("at"))  # the 300th
    total = d.agg(F.count("*").alias("n"), F.max("degree").alias("top"))
    over = d.crossJoin(F.broadcast(at)).agg(F.coalesce(F.sum((F.col("degree") >= F.col("at")).cast("int")), F.lit(0)).alias("over"), F.max("at").alias("at"))
    both = total.crossJoin(over)
    least = F.col("at") + F.when(F.col("over") > 450, 1).otherwise(0)
    pct = F.greatest(F.lit(1), F.least(F.lit(20), F.ceil(100 * least / F.col("top"))))
    return both.select("n", F.when(F.col("n") <= 200, F.lit(5)).otherwise(pct).cast("long").alias("percent"))


def visible_edges(e: DataFrame, nodes: DataFrame, families: list[str]) -> DataFrame:
    """Edges of the families whose ends are both among the visible nodes."""
    out = e.filter(text.causal_family(F.col("rel")).isin(families))
    for end in ("sub", "obj"):
        out = out.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return out


def long_tail(counts: DataFrame, share: float = 0.01, least: int = 6) -> DataFrame:
    """Types (a closed set) with their share, the tail cut but for the first few."""
    w = Window.orderBy(F.desc("n"), "type")
    ranked = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("rn", F.row_number().over(w))
    return ranked.filter((F.col("share") >= share) | (F.col("rn") <= least)).select("type", "n")


def node_detail(e: DataFrame, node: str) -> DataFrame:
    out = e.filter(F.col("sub") == node).select(F.lit("out").alias("side"), F.col("obj").alias("other"), "rel", "weight")
    return out.unionByName(e.filter(F.col("obj") == node).select(F.lit("in").alias("side"), F.col("sub").alias("other"), "rel", "weight"))


def neighbourhood(e: DataFrame, node: str) -> DataFrame:
    """The closed neighbourhood of a node, and whether an element belongs to it."""
    near = e.filter((F.col("sub") == node) | (F.col("obj") == node)).select(F.explode(F.array("sub", "obj")).alias("node")).distinct()
    every = ends(e).select("node").distinct()
    return every.join(near.withColumn("near", F.lit(True)), "node", "left").select("node", F.coalesce("near", F.lit(False)).alias("near"))


def undirected(e: DataFrame) -> DataFrame:
    """One link for each unordered pair, without self-loops."""
    return e.filter("sub <> obj").select(F.least("sub", "obj").alias("a"), F.greatest("sub", "obj").alias("b")).distinct()


def anchor_month(nodes: DataFrame) -> DataFrame:
    """The month with most nodes, the later of equals."""
    counts = nodes.groupBy("month").agg(F.count("*").alias("n"))
    return counts.agg(F.max_by("month", F.struct("n", "month")).alias("anchor"))


def clean_merge(e: DataFrame, order: str | None = None, *keep: str) -> DataFrame:
    """Edges after renaming: junk ends and self-loops go, equal ones add up; of the
    columns to keep, those of the first by ``order`` stand."""
    kept = e.filter(~text.is_junk(F.col("sub")) & ~text.is_junk(F.col("obj")) & (F.col("sub") != F.col("obj")))
    weight = F.when(F.coalesce("weight", F.lit(0)) == 0, 1).otherwise(F.col("weight"))
    return kept.groupBy("month", "sub", "rel", "obj").agg(F.sum(weight).alias("weight"), *(F.min_by(c, order).alias(c) for c in keep))


def label_budget(d: DataFrame, component: Column, least: int = 80, share: float = 0.4, all_up_to: int = 220, all_from: int = 8) -> DataFrame:
    """Nodes that get a label: the top by degree, and the top of each component.

    A graph of few nodes, or of many components, labels all.
    """
    x = positions(d.withColumn("_component", component), F.desc("degree"), "node")
    tops = x.groupBy("_component").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_top"))
    whole = x.agg(F.count("*").alias("_n"), F.count_distinct("_component").alias("_parts"))  # one row
    every = (F.col("_n") <= all_up_to) | (F.col("_parts") >= all_from)
    budget = F.greatest(F.lit(least), F.floor(share * F.col("_n") + 0.5))
    return x.join(tops, "pos", "left").crossJoin(F.broadcast(whole)).filter(every | (F.col("pos") < budget) | F.col("_top")).select(d.columns)
