"""Queries that a user or a client asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import canon, factors, generate, graph, ml, predict, serving
from ..operators.lineage import cut
from ..sources.adapter import ARTICLES_SQL, TRIPLETS_SQL, articles, table, triplets
from .analytics import ACT, AT, DIMS, KEYWORDS, PERIODS, SNAP
from .graphs import EDGES, edges, family_sql
from .registry import query

W = f"WITH {TRIPLETS_SQL}"
SOURCE, MONTH = "GMM", "1996-03"


def sourced(spark: SparkSession, d: str) -> DataFrame:
    """Enriched edges of each source; a category is a corpus."""
    t = triplets(spark, d).withColumn("month", F.concat("rel_category", F.lit("/"), "month"))
    e = graph.enriched_edges(t)
    return e.withColumn("source", F.substring_index("month", "/", 1)).withColumn("month", F.substring_index("month", "/", -1))


@query(f"""{EDGES} SELECT rel_category AS source, array_to_string(list_sort(list(DISTINCT "month")), '|') AS months, max("month") AS latest FROM edges GROUP BY rel_category""")
def ap_timeline(spark, d):
    t = serving.timeline(edges(spark, d).withColumnRenamed("rel_category", "source"))
    return t.select("source", F.array_join("months", "|").alias("months"), "latest")


@query(f"""{W}, snap AS (SELECT sub, rel, obj, count(*) AS weight, round(avg(sentiment), 4) AS sentiment, coalesce(sum(materiality_usd) FILTER (materiality_usd > 0), 0)::DOUBLE AS materiality_usd FROM triplets WHERE rel_category = '{SOURCE}' AND "month" = '{MONTH}' GROUP BY ALL),
n AS (SELECT node, sum(weight) AS degree FROM (SELECT sub AS node, weight FROM snap UNION ALL SELECT obj, weight FROM snap) GROUP BY node), top AS (SELECT node FROM n ORDER BY degree DESC, node LIMIT 120)
SELECT sub, rel, obj, weight, sentiment, materiality_usd, (SELECT count(*) FROM n) AS total_entities, (SELECT count(*) FROM snap) AS total_relationships FROM snap
WHERE sub IN (SELECT node FROM top) AND obj IN (SELECT node FROM top) ORDER BY weight DESC, sub, rel, obj LIMIT 200""")
def ap_get_graph(spark, d):
    """A source's month: the heaviest edges among the busiest nodes, and the totals."""
    g = serving.get_graph(sourced(spark, d), SOURCE, MONTH, 500)
    return g.select("sub", "rel", "obj", "weight", "sentiment", "materiality_usd", "total_entities", "total_relationships")


@query(SNAP.replace("FROM triplets GROUP BY ALL)", "FROM triplets WHERE \"month\" >= (SELECT max(\"month\") FROM (SELECT DISTINCT \"month\" FROM triplets WHERE \"month\" < (SELECT max(\"month\") FROM triplets))) GROUP BY ALL)")
       + " SELECT sub, attention, round(sentiment, 5) + 0.0 AS sentiment, round(consensus, 5) AS consensus, round(materiality, 5) AS materiality, round(novelty, 5) AS novelty FROM sf")
def ap_get_factors(spark, d):
    """Factors over the last two months that exist."""
    f = serving.window_factors(graph.enriched_edges(serving.last_months(triplets(spark, d))))
    return f.select("sub", "attention", *(F.round(c, 5).alias(c) for c in factors.FACTORS[1:]))


def _period_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of one period's entities; suppliers where there are some."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("vec_id"), "s_name")
    v = table(spark, d, "embeddings").join(s, "vec_id", "left")
    name = F.when(F.col("vec_id") % 50 == 49, "Price Target").otherwise(F.concat(F.coalesce("s_name", F.concat(F.lit("node "), F.floor(F.col("vec_id") / 3).cast("string"))), F.when(F.col("vec_id") % 3 == 1, " Inc").otherwise("")))
    kind = F.when(F.col("label") % 4 == 0, "Company").when(F.col("label") % 4 == 1, "STOCKTICKER").when(F.col("label") % 4 == 2, "CONCEPT").otherwise("UNK")
    return v.select(name.alias("entity"), kind.alias("entity_type"), F.col("embedding").cast("array<double>").alias("e"), "vec_id")


PREDICTED = f"""{W}, {PERIODS}, {ACT}, cur AS (SELECT p AS latest FROM p WHERE "month" = '{AT}'),
nodes AS (SELECT CASE WHEN vec_id % 50 = 49 THEN 'Price Target' ELSE coalesce(s_name, 'node ' || vec_id // 3) || CASE WHEN vec_id % 3 = 1 THEN ' Inc' ELSE '' END END AS entity,
  CASE label % 4 WHEN 0 THEN 'COMPANY' WHEN 1 THEN 'STOCKTICKER' WHEN 2 THEN 'CONCEPT' ELSE 'UNK' END AS kind, embedding::DOUBLE[] AS e, vec_id FROM embeddings LEFT JOIN supplier ON vec_id = s_suppkey),
imp AS (SELECT a.entity, a.kind, a.e, a.vec_id, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_inner_product(a.e, b.e) END) / count(*) AS importance FROM nodes a CROSS JOIN nodes b GROUP BY ALL),
good AS (SELECT *, regexp_replace(regexp_replace(lower(entity), ' inc$', ''), '[^a-z0-9]', '', 'g') AS alias FROM imp WHERE entity <> 'Price Target'),
one AS (SELECT * FROM good WHERE kind IN ('COMPANY', 'STOCKTICKER') QUALIFY row_number() OVER (PARTITION BY alias ORDER BY importance DESC, entity) = 1),
lead AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, entity) AS rank FROM one) WHERE rank <= 40),
pr AS (SELECT l.entity AS source, g.entity, g.alias, list_inner_product(g.e, l.e) AS score FROM good g JOIN lead l ON g.alias <> l.alias WHERE g.kind <> 'UNK'),
o AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY source, alias ORDER BY score DESC, entity) = 1),
co AS (SELECT source, string_agg(entity, '|' ORDER BY rank) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, entity) AS rank FROM o) WHERE rank <= 5 GROUP BY source),
r AS (SELECT entity, coalesce(sum(n) FILTER (p > latest - 3), 0) - coalesce(sum(n) FILTER (p <= latest - 3), 0)::DOUBLE / (any_value(latest) - 3) AS raw FROM act JOIN p USING ("month"), cur WHERE p <= latest GROUP BY entity),
z AS (SELECT lead.entity, coalesce(raw, 0) AS raw FROM lead LEFT JOIN r USING (entity)),
t AS (SELECT entity, [sum(n * (p = latest - 2)::INT), sum(n * (p = latest - 1)::INT), sum(n * (p = latest)::INT)] AS tr FROM act JOIN p USING ("month"), cur GROUP BY entity)
SELECT rank, lead.entity, kind AS entity_type, round(CASE WHEN stddev_pop(raw) OVER () < 1e-6 THEN 0 ELSE (raw - avg(raw) OVER ()) / stddev_pop(raw) OVER () END, 3) AS novelty_z,
  coalesce(array_to_string(tr, ','), '0,0,0') AS trend, targets FROM lead JOIN z USING (entity) LEFT JOIN t USING (entity) LEFT JOIN co ON source = lead.entity"""


@query(PREDICTED)
def ap_get_predictions(spark, d):
    """One period's leaderboard with novelty, trend and targets."""
    nodes = _period_nodes(spark, d).drop("vec_id")
    entries = predict.period_predictions(nodes, triplets(spark, d, False), AT, DIMS).withColumn("period", F.lit(AT))
    p = serving.of_period(entries, "period")
    return p.select("rank", "entity", "entity_type", "novelty_z", F.array_join(F.transform("trend", lambda x: x.cast("string")), ",").alias("trend"), F.array_join("targets", "|").alias("targets"))


PREDICTED_ALL = f"""{W}, {PERIODS}, {ACT},
nodes AS (SELECT CASE vec_id % 4 WHEN 0 THEN '1996-06' WHEN 1 THEN '1992-03' WHEN 2 THEN '1998-01' ELSE '2030-01' END AS period, coalesce(s_name, 'node ' || vec_id // 12) || CASE WHEN vec_id % 3 = 1 THEN ' Inc' ELSE '' END AS entity,
  CASE label % 4 WHEN 0 THEN 'COMPANY' WHEN 1 THEN 'STOCKTICKER' WHEN 2 THEN 'CONCEPT' ELSE 'UNK' END AS kind, embedding::DOUBLE[] AS e, vec_id FROM embeddings LEFT JOIN supplier ON vec_id // 4 = s_suppkey),
imp AS (SELECT a.period, a.entity, a.kind, a.e, a.vec_id, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_inner_product(a.e, b.e) END) / count(*) AS importance, count(*) AS total FROM nodes a JOIN nodes b USING (period) GROUP BY ALL),
good AS (SELECT imp.*, regexp_replace(regexp_replace(lower(entity), ' inc$', ''), '[^a-z0-9]', '', 'g') AS alias, p AS latest FROM imp JOIN p ON "month" = period),
one AS (SELECT * FROM good WHERE kind IN ('COMPANY', 'STOCKTICKER') QUALIFY row_number() OVER (PARTITION BY period, alias ORDER BY importance DESC, entity) = 1),
lead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY importance DESC, entity) AS rank FROM one) WHERE rank <= 15),
pr AS (SELECT l.period, l.entity AS source, g.entity, g.alias, list_inner_product(g.e, l.e) AS score FROM good g JOIN lead l ON g.period = l.period AND g.alias <> l.alias WHERE g.kind <> 'UNK'),
o AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY period, source, alias ORDER BY score DESC, entity) = 1),
co AS (SELECT period, source, string_agg(entity, '|' ORDER BY rank) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY period, source ORDER BY score DESC, entity) AS rank FROM o) WHERE rank <= 3 GROUP BY ALL),
r AS (SELECT lead.period, lead.entity, coalesce(sum(n) FILTER (p > latest - 3 AND p <= latest), 0) - coalesce(coalesce(sum(n) FILTER (p <= latest - 3), 0)::DOUBLE / nullif(greatest(any_value(latest) - 3, 0), 0), 0) AS raw,
  [coalesce(sum(n) FILTER (p = latest - 2), 0), coalesce(sum(n) FILTER (p = latest - 1), 0), coalesce(sum(n) FILTER (p = latest), 0)] AS tr FROM lead LEFT JOIN (SELECT * FROM act JOIN p USING ("month")) USING (entity) GROUP BY ALL),
s AS (SELECT *, stddev_pop(raw) OVER (PARTITION BY period) AS dev, avg(raw) OVER (PARTITION BY period) AS mean FROM r)
SELECT lead.period, total AS total_entities, rank, entity, kind AS entity_type, round(CASE WHEN dev < 1e-6 THEN 0 ELSE (raw - mean) / dev END, 3) AS novelty_z, array_to_string(tr, ',') AS trend, coalesce(targets, '') AS targets
FROM lead JOIN s USING (period, entity) LEFT JOIN co ON co.period = lead.period AND source = lead.entity"""


@query(PREDICTED_ALL)
def pred_all_periods(spark, d):
    """The leaderboards of three months at once; a fourth period has no triplets."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("_key"), "s_name")
    v = table(spark, d, "embeddings").withColumn("_key", F.floor(F.col("vec_id") / 4)).join(s, "_key", "left")
    k = F.col("vec_id") % 4
    period = F.when(k == 0, "1996-06").when(k == 1, "1992-03").when(k == 2, "1998-01").otherwise("2030-01")
    name = F.concat(F.coalesce("s_name", F.concat(F.lit("node "), F.floor(F.col("vec_id") / 12).cast("string"))), F.when(F.col("vec_id") % 3 == 1, " Inc").otherwise(""))
    kind = F.when(F.col("label") % 4 == 0, "Company").when(F.col("label") % 4 == 1, "STOCKTICKER").when(F.col("label") % 4 == 2, "CONCEPT").otherwise("UNK")
    nodes = v.select(period.alias("period"), name.alias("entity"), kind.alias("entity_type"), F.col("embedding").cast("array<double>").alias("e"))
    p = predict.all_predictions(nodes, triplets(spark, d, False), DIMS, 15, 3)
    return p.withColumns({"trend": F.array_join(F.transform("trend", lambda x: x.cast("string")), ","), "targets": F.array_join("targets", "|")})


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    score = F.when(F.col("weight") > 1, F.col("weight") / 10).when(F.substring("month", 7, 1) == "3", 0.25)
    origin = F.when(F.substring("month", 7, 1).isin("1", "2"), "predicted").when(F.substring("month", 7, 1) == "5", "news")
    return e.withColumns({"score": score, "origin": origin, "polarity": F.substring("month", 6, 2), "causal_type": F.when(F.substring("month", 6, 2) > "03", F.substring("month", 1, 4))})


SCORED = f"""{EDGES}, s AS (SELECT *, CASE WHEN weight > 1 THEN weight / 10.0 WHEN substring("month", 7, 1) = '3' THEN 0.25 END AS score, CASE WHEN substring("month", 7, 1) IN ('1', '2') THEN 'predicted' WHEN substring("month", 7, 1) = '5' THEN 'news' END AS origin,
  substring("month", 6, 2) AS polarity, CASE WHEN substring("month", 6, 2) > '03' THEN substring("month", 1, 4) END AS causal_type FROM edges),
f AS (SELECT *, row_number() OVER (PARTITION BY sub, obj, rel, rel_category ORDER BY "month") AS rn FROM s),
m AS (SELECT sub, obj, rel, rel_category, sum(weight)::BIGINT AS weight, max(score)::DOUBLE AS score, CASE WHEN bool_or(coalesce(origin, 'news') = 'news') THEN 'news' ELSE 'predicted' END AS origin,
  max(polarity) FILTER (rn = 1) AS polarity, coalesce(max(causal_type) FILTER (rn = 1), 'OTHER') AS causal_type FROM f GROUP BY ALL)"""


@query(f"{SCORED} SELECT * FROM m")
def kg_merge_full(spark, d):
    """All months as one graph, with scores, origins and first attributes."""
    return graph.merge_full(_scored(spark, d))


@query(f"{SCORED} SELECT count(*) AS edges, count(score) AS scored_edges, (SELECT count(DISTINCT n) FROM (SELECT sub AS n FROM m UNION ALL SELECT obj FROM m)) AS nodes FROM m")
def kg_graph_stats(spark, d):
    return graph.graph_stats(graph.merge_full(_scored(spark, d)))


@query(f"""{W}, o AS (SELECT "month", url, seq, 0 AS side, sub AS node, upper(trim(sub_type)) AS type FROM triplets WHERE sub <> 'UNK' AND obj <> 'UNK' UNION ALL SELECT "month", url, seq, 1, obj, upper(trim(obj_type)) FROM triplets WHERE sub <> 'UNK' AND obj <> 'UNK')
SELECT "month", node, arg_min(type, (url, seq, side)) AS type FROM o GROUP BY ALL""")
def kg_live_types(spark, d):
    """Types of the live writer: upper case as they are, the first wins, unknown entities go."""
    return graph.node_types(graph.clean(triplets(spark, d, False), drop_unknown=True), "first", "month", kind=text.raw_type)


@query(f"""{W}, e AS (SELECT "month", sub, rel, substring(obj, 1, 7) AS obj, rel_category, min((url, seq)) AS seen, count(*) AS weight FROM triplets GROUP BY "month", sub, rel, rel_category, obj)
SELECT "month", sub, rel, obj, sum(weight)::BIGINT AS weight, arg_min(rel_category, seen) AS rel_category FROM e GROUP BY "month", sub, rel, substring(obj, 1, 7), obj""")
def canon_merge_first(spark, d):
    """Edges merged after renaming, with the attributes of the first."""
    t = triplets(spark, d, False)
    e = t.groupBy("month", "sub", "rel", "obj", "rel_category").agg(F.min(F.struct("url", "seq")).alias("at"), F.count("*").alias("weight"))
    return graph.clean_merge(e.withColumn("obj", F.substring("obj", 1, 7)), "at", "rel_category")


@query(f"""{EDGES}, m AS (SELECT DISTINCT "month" FROM edges) SELECT source, count(*)::INT AS n, array_to_string(list_sort(list(DISTINCT lang))[1:2], '|') || CASE WHEN count(DISTINCT lang) > 2 THEN ' +' || (count(DISTINCT lang) - 2) || ' more' ELSE '' END AS preview,
  '199' || (substring(source, 4)::INT % 10) || '-05' IN (SELECT "month" FROM m) AS noted FROM documents WHERE source IS NOT NULL GROUP BY source""")
def ap_source_notes(spark, d):
    """Sources with a preview of their languages, and whether their end note's month is there."""
    s = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_set("lang")).alias("langs"))
    s = s.withColumn("end_note_month", F.concat(F.lit("199"), (F.substring("source", 4, 9).cast("int") % 10).cast("string"), F.lit("-05")))
    noted = serving.end_notes(s, edges(spark, d).select("month").distinct())
    return noted.select("source", "n", serving.preview(F.col("langs"), 2).alias("preview"), "noted")


@query(f"""{EDGES}, m AS (SELECT DISTINCT "month" FROM edges WHERE rel_category = '{SOURCE}' AND weight > 2) SELECT DISTINCT "month" FROM edges WHERE "month" NOT IN (SELECT "month" FROM m)""")
def kg_missing_months(spark, d):
    """Months of the index that a client does not hold yet."""
    e = edges(spark, d)
    return serving.missing(e.select("month").distinct(), e.filter((F.col("rel_category") == SOURCE) & (F.col("weight") > 2)).select("month"), "month")


FAM = family_sql("historical")


@query(f"""{W}, o AS (SELECT sub AS node, sub_type AS t FROM triplets UNION ALL SELECT obj, obj_type FROM triplets),
k AS (SELECT node, max(CASE t WHEN 'STOCK_TICKER' THEN 'STOCKTICKER' ELSE t END) AS type FROM o GROUP BY node), r AS (SELECT DISTINCT sub, obj, rel FROM triplets)
SELECT 'type' AS facet, type AS value, count(*) AS n FROM k GROUP BY type UNION ALL SELECT 'family', {FAM}, count(*) FROM r GROUP BY ALL UNION ALL SELECT 'month', "month", count(*) FROM (SELECT DISTINCT "month", sub, rel, obj FROM triplets) GROUP BY ALL""")
def kg_facet_counts(spark, d):
    """How many nodes have each type, and edges each family and month."""
    t = triplets(spark, d, False)
    types = graph.occurrences(t).groupBy("node").agg(F.max("type").alias("type"))
    family = serving.facet("family", text.causal_family(F.col("rel")), t.select("sub", "obj", "rel").distinct())
    return serving.facet("type", F.col("type"), types).unionByName(family).unionByName(serving.facet("month", F.col("month"), t.select("month", "sub", "rel", "obj").distinct()))


@query(f"""{EDGES}, deg AS (SELECT node, sum(weight)::BIGINT AS degree FROM (SELECT sub AS node, weight FROM edges UNION ALL SELECT obj, weight FROM edges) GROUP BY node)
SELECT node, degree FROM deg WHERE degree >= 100 AND (node LIKE 'Brand%' OR length(node) % 2 = 1) AND right(node, 1) IN ('1', '2', '3')""")
def kg_visible_nodes(spark, d):
    """Nodes of chosen types and sectors with at least a degree."""
    n = graph.weighted_degree(edges(spark, d))
    n = n.withColumn("type", F.when(F.col("node").startswith("Brand"), "PRODUCT").when(F.length("node") % 2 == 1, "COMPANY").otherwise("UNK")).withColumn("sector", F.substring("node", -1, 1))
    return graph.visible_nodes(n, ["PRODUCT", "COMPANY"], 100, ["1", "2", "3"]).select("node", "degree")


@query(f"""{W}, e AS (SELECT "month", sub, obj, rel, rel_category, count(*) AS weight, min((url, seq)) AS first FROM triplets GROUP BY ALL)
SELECT "month", sub, obj, rel, rel_category, weight, 'e' || (row_number() OVER (PARTITION BY "month" ORDER BY first) - 1) AS id FROM e""")
def kg_first_seen_ids(spark, d):
    return graph.first_seen_ids(triplets(spark, d, False))


@query(f"""{EDGES}, m AS (SELECT DISTINCT "month" FROM edges), i AS (SELECT "month", row_number() OVER (ORDER BY "month") - 1 AS i FROM m)
SELECT a."month", a."month" > '1997-06' AS ahead, strftime(strptime(a."month" || '-01', '%Y-%m-%d'), '%b %Y') AS label, f."month" AS first, l."month" AS last FROM i a JOIN i f ON f.i = greatest(0, a.i - 3) JOIN i l ON l.i = greatest(greatest(0, a.i - 3), a.i - 1)""")
def kg_months(spark, d):
    """Months with their label, whether they lie ahead, and what they are trained on."""
    m = edges(spark, d).select("month").distinct()
    s = serving.split_months(m, "1997-06-17").withColumn("label", text.month_label(F.col("month")))
    return s.join(serving.training_bounds(m), "month").select("month", "ahead", "label", "first", "last")


@query(f"""{EDGES}, i AS (SELECT "month", row_number() OVER (ORDER BY "month") AS i FROM (SELECT DISTINCT "month" FROM edges)), e AS (SELECT i AS e FROM i WHERE "month" = '{MONTH}'),
p AS (SELECT s || 'M' AS label, min("month") AS first, max("month") AS last FROM i, e, (VALUES (1), (3), (6), (12)) v(s) WHERE i <= e AND i > e - s GROUP BY s UNION ALL SELECT 'All', min("month"), max("month") FROM i),
l AS (SELECT *, strftime(strptime(first || '-01', '%Y-%m-%d'), '%b %Y') AS f, strftime(strptime(last || '-01', '%Y-%m-%d'), '%b %Y') AS t FROM p)
SELECT label, first, last, CASE WHEN first = last THEN f ELSE f || ' → ' || t END AS range FROM l""")
def kg_presets(spark, d):
    """Ranges that end at a month, and the whole range."""
    p = serving.presets(edges(spark, d), MONTH)
    return p.withColumn("range", text.range_label(F.col("first"), F.col("last")))


@query(f"""{EDGES}, deg AS (SELECT node, sum(weight)::BIGINT AS degree FROM (SELECT sub AS node, weight FROM edges UNION ALL SELECT obj, weight FROM edges) GROUP BY node)
SELECT node, degree, round(50 * sqrt(degree / (SELECT max(degree) FROM deg)), 6) AS size, round(12 + (least(greatest(degree, 1), 15) - 1) * 2.0, 6)::DOUBLE AS width FROM deg ORDER BY degree DESC, node LIMIT 500""")
def kg_palette(spark, d):
    """The busiest nodes of all, with the size and width that they are drawn in."""
    top = serving.size_scale(graph.weighted_degree(edges(spark, d))).orderBy(F.desc("degree"), "node").limit(500)
    return top.select("node", "degree", F.round("size", 6).alias("size"), F.round(text.rescale(F.col("degree"), 1, 15, 12, 40), 6).alias("width"))


@query(f"""{W}, k AS (SELECT DISTINCT sub_type AS t FROM triplets UNION SELECT obj_type FROM triplets)
SELECT array_to_string(list_sort(list_distinct(list_concat(['OLD', 'PRODUCT'], list(t)))), ',') AS known, array_to_string(list_sort(list_distinct(list_concat(['OLD'], list(t) FILTER (t NOT IN ('PRODUCT', 'UNK'))))), ',') AS visible FROM k""")
def kg_type_state(spark, d):
    """Types known and shown after a graph: what was off stays off, UNK is hidden."""
    t = triplets(spark, d, False)
    seen = t.select(F.explode(F.array("sub_type", "obj_type")).alias("type"))
    out = serving.type_state(["OLD", "PRODUCT"], ["OLD"], seen, ("UNK",))
    return out.select(F.array_join("known", ",").alias("known"), F.array_join("visible", ",").alias("visible"))


@query(f"""{W}, x AS (SELECT sub AS name, url, seq, 0 AS side FROM triplets UNION ALL SELECT obj, url, seq, 1 FROM triplets), f AS (SELECT name, min((url, seq, side)) AS first FROM x GROUP BY name)
SELECT name, row_number() OVER (ORDER BY first) AS ord FROM f ORDER BY first LIMIT 400""")
def ud_name_pool(spark, d):
    """Names in the order in which they are first seen, as many as a prompt holds."""
    names = generate.name_pool(triplets(spark, d, False))
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(names)], "name string, ord long")


@query(f"""{W}, l AS (SELECT sub, url, arg_max(sentiment, seq) AS s FROM triplets GROUP BY ALL), p AS (SELECT sub, count(*) AS attention, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(0, 1 - stddev_pop(s)) END AS consensus FROM l GROUP BY sub)
SELECT sub, attention, round(consensus, 6) AS consensus, 0.0::DOUBLE AS momentum, round(avg(sentiment), 6) + 0.0 AS sentiment, round(ln(1 + coalesce(sum(materiality_usd) FILTER (materiality_usd > 0), 0)::DOUBLE), 6) AS materiality, count(DISTINCT event_type) AS event_diversity
FROM triplets JOIN p USING (sub) GROUP BY ALL""")
def factor_preview(spark, d):
    f = factors.preview_factors(triplets(spark, d))
    return f.select("sub", "attention", F.round("consensus", 6).alias("consensus"), "momentum", F.round("sentiment", 6).alias("sentiment"), F.round("materiality", 6).alias("materiality"), "event_diversity")


@query(f"""{W}, c AS (SELECT sub, event_type, count(*) AS n, min((url, seq)) AS first FROM triplets GROUP BY ALL)
SELECT sub, event_type, n, rn FROM (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY n DESC, first) AS rn FROM c) WHERE rn <= 5""")
def factor_event_first(spark, d):
    """The five commonest events of each entity, ties by first sight."""
    t = triplets(spark, d).withColumns({"weight": F.lit(1), "at": F.struct("url", "seq")})
    return factors.event_mix(t, 5, "at")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by date with loadings on the five factors."""
    k, s = F.col("p_partkey"), F.col("p_size")
    loads = (s % 7 - 3, k % 5 - 2, s % 3 - 1, k % 11 - 5, s % 9 - 4)
    each = F.array(*(F.struct(F.lit(f).alias("factor"), v.cast("double").alias("loading")) for f, v in zip(factors.FACTORS, loads, strict=True)))
    return table(spark, d, "part").select(F.concat(F.lit("d"), s.cast("string")).alias("date"), k.cast("int").alias("cluster"), serving.signature(each).alias("signature"))


SIGNS = """l AS (SELECT 'd' || p_size AS date, p_partkey::INT AS cluster, unnest([{'f': 'attention', 'i': 1, 'v': p_size % 7 - 3}, {'f': 'sentiment', 'i': 2, 'v': p_partkey % 5 - 2}, {'f': 'consensus', 'i': 3, 'v': p_size % 3 - 1}, {'f': 'novelty', 'i': 4, 'v': p_partkey % 11 - 5}, {'f': 'materiality', 'i': 5, 'v': p_size % 9 - 4}]) AS x FROM part),
k AS (SELECT date, cluster, x.f AS f, x.i AS i, x.v AS v FROM l QUALIFY row_number() OVER (PARTITION BY date, cluster ORDER BY abs(x.v) DESC, x.i) <= 3),
sig AS (SELECT date, cluster, string_agg(f || CASE WHEN v > 0 THEN '+' ELSE '-' END, '|' ORDER BY i) AS key, sum(CASE WHEN v > 0 THEN 1 ELSE 2 END * (3 ** (5 - i)))::INT AS index,
  string_agg(CASE f WHEN 'attention' THEN CASE WHEN v > 0 THEN 'heavily covered' ELSE 'flying under the radar' END WHEN 'sentiment' THEN CASE WHEN v > 0 THEN 'getting positive press' ELSE 'getting negative press' END
    WHEN 'consensus' THEN CASE WHEN v > 0 THEN 'sources in agreement' ELSE 'a contested storyline' END WHEN 'novelty' THEN CASE WHEN v > 0 THEN 'making headlines of its own' ELSE 'mentioned in passing in others'' coverage' END
    ELSE CASE WHEN v > 0 THEN 'big money on the table' ELSE 'little money at stake' END END, ', ' ORDER BY i) AS words FROM k GROUP BY ALL)"""


@query(f"WITH {SIGNS} SELECT * FROM sig")
def factor_signatures(spark, d):
    """Keys, indices and readings of clusters' strongest factors."""
    s = F.col("signature")
    return _clusters(spark, d).select("date", "cluster", serving.signature_key(s).alias("key"), serving.signature_index(s).alias("index"), serving.signature_text(s).alias("words"))


PIN = "attention+|novelty-|materiality+"


@query(f"""WITH {SIGNS} SELECT 'key' AS kind, key AS name, count(DISTINCT key)::INT AS cluster FROM sig GROUP BY key UNION ALL SELECT 'pinned', date, coalesce(min(cluster) FILTER (key = '{PIN}'), -1) FROM sig GROUP BY date""")
def factor_archetypes(spark, d):
    """All keys, and the cluster that has a pinned one on each date."""
    c = _clusters(spark, d)
    keys = serving.archetypes(c).select(F.lit("key").alias("kind"), F.col("key").alias("name"), F.lit(1).alias("cluster"))
    return keys.unionByName(serving.pinned(c, PIN).select(F.lit("pinned").alias("kind"), F.col("date").alias("name"), "cluster"))


@query(f"""{W} SELECT "month", count(DISTINCT url) AS articles, count(*) AS triplets FROM triplets GROUP BY "month\"""")
def corpus_totals(spark, d):
    """Articles and triplets of each month."""
    return triplets(spark, d, False).groupBy("month").agg(F.count_distinct("url").alias("articles"), F.count("*").alias("triplets"))


@query(f"""WITH {ARTICLES_SQL}, {TRIPLETS_SQL}, n AS (SELECT url, count(*) AS n FROM triplets GROUP BY url)
SELECT 'doc://' || doc_id AS url, coalesce(n, 0) AS n FROM documents LEFT JOIN n ON n.url = 'order://' || doc_id""")
def article_triplets(spark, d):
    """Every article with how many triplets it has."""
    n = triplets(spark, d, False).groupBy("url").agg(F.count("*").alias("n"))
    return articles(spark, d).select("url").withColumn("_key", F.replace("url", F.lit("doc:"), F.lit("order:"))).join(n.withColumnRenamed("url", "_key"), "_key", "left").select("url", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""{W}, p AS (SELECT a.url, count(*) FILTER (a.sub = b.sub OR a.obj = b.obj) AS alike FROM triplets a JOIN triplets b ON a.url = b.url AND a.seq < b.seq GROUP BY a.url), n AS (SELECT url, count(*) AS n FROM triplets GROUP BY url)
SELECT url, round(1 - coalesce(2.0 * alike / nullif(n * (n - 1), 0), 0), 6) AS uniqueness FROM n LEFT JOIN p USING (url)""")
def judge_uniqueness(spark, d):
    """An article's share of triplets that are not like another; its triplets are few."""
    t = triplets(spark, d, False).select("url", "seq", "sub", "obj")
    other = t.select("url", F.col("seq").alias("seq2"), F.col("sub").alias("sub2"), F.col("obj").alias("obj2"))
    pairs = t.join(other, "url").filter("seq < seq2").select("url", F.when((F.col("sub") == F.col("sub2")) | (F.col("obj") == F.col("obj2")), 1.0).otherwise(0.0).alias("likeness"))
    return serving.uniqueness(pairs, t, 0.5).select("url", F.round("uniqueness", 6).alias("uniqueness"))


@query(f"""{W}, v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), k AS (SELECT url, seq, (ascii(substring(sub, length(sub), 1)) - 48) % 4 * 10 + length(obj) AS vec_id FROM triplets), t AS (SELECT url, seq, v FROM k JOIN v USING (vec_id)),
p AS (SELECT a.url, count(*) FILTER (list_cosine_similarity(a.v, b.v) > 0.9) AS alike FROM t a JOIN t b ON a.url = b.url AND a.seq < b.seq GROUP BY a.url), n AS (SELECT url, count(*) AS n FROM t GROUP BY url)
SELECT url, round(1 - coalesce(2.0 * alike / nullif(n * (n - 1), 0), 0), 6) AS uniqueness FROM n LEFT JOIN p USING (url)""")
def judge_cosine_uniqueness(spark, d):
    """An article's share of pairs of triplets whose vectors are not alike."""
    vec = (F.ascii(F.expr("right(sub, 1)")) - 48) % 4 * 10 + F.length("obj")
    t = triplets(spark, d, False).select("url", "seq", vec.cast("long").alias("vec_id"))
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    items = t.join(vectors.select("vec_id"), "vec_id")
    return serving.uniqueness(serving.cosine_pairs(items, vectors), items, 0.9).select("url", F.round("uniqueness", 6).alias("uniqueness"))


@query(f"""{W}, u AS (SELECT DISTINCT 'order://' || l_orderkey AS url, 'brand#' || (l_partkey % 5 + 1) || (l_suppkey % 5 + 1) AS unit FROM lineitem), hit AS (SELECT DISTINCT url, lower(obj) AS unit, 1 AS hit FROM triplets),
c AS (SELECT url, round(count(hit)::DOUBLE / count(*), 6) AS coverage FROM u LEFT JOIN hit USING (url, unit) GROUP BY url),
v AS (SELECT url, round(avg((sub_type <> 'UNK' AND obj_type <> 'UNK')::INT), 6) AS validity FROM triplets GROUP BY url),
e AS (SELECT url, count(*) FILTER (round(sentiment, 6) > 0.15) * count(*) FILTER (round(sentiment, 6) < -0.15) AS bad, count(*) AS n FROM triplets GROUP BY url, sub, obj),
k AS (SELECT url, round(1 - coalesce(2.0 * sum(bad) / nullif(sum(n) * (sum(n) - 1), 0), 0), 6)::DOUBLE AS consistency FROM e GROUP BY url)
SELECT url, coverage, validity, consistency FROM c JOIN v USING (url) JOIN k USING (url)""")
def judge_metrics(spark, d):
    """Coverage of an article's units, validity and consistency of its triplets."""
    t = triplets(spark, d, False)
    unit = F.format_string("Brand#%d%d", F.col("l_partkey") % 5 + 1, F.col("l_suppkey") % 5 + 1)
    units = table(spark, d, "lineitem").select(F.concat(F.lit("order://"), F.col("l_orderkey").cast("string")).alias("url"), unit.alias("unit"))
    r6 = lambda c: F.round(c, 6).alias(c)
    return serving.coverage(units, t).join(serving.validity(t), "url").join(serving.consistency(t), "url").select("url", r6("coverage"), r6("validity"), r6("consistency"))


@query(f"""{EDGES}, m AS (SELECT rel_category AS source, array_to_string(list_sort(list(DISTINCT "month")), '|') AS months, max("month") AS latest FROM edges GROUP BY rel_category),
f AS (SELECT rel_category AS source, array_to_string(list_sort(list(DISTINCT "month" || '-28')), '|') AS dates FROM edges WHERE rel_category <> 'SSI' AND "month" >= '1997-01' GROUP BY rel_category)
SELECT source, months, latest, coalesce(dates, '') AS factor_dates FROM m LEFT JOIN f USING (source)""")
def ap_dated_timeline(spark, d):
    """Months of each source, and the dates of its factor bundles; one has none."""
    e = edges(spark, d).withColumnRenamed("rel_category", "source")
    bundles = e.filter("source <> 'SSI' and month >= '1997-01'").groupBy("source", F.concat("month", F.lit("-28")).alias("date")).agg(F.count("*").alias("entities"))
    out = serving.dated_timeline(e, bundles)
    return out.select("source", F.array_join("months", "|").alias("months"), "latest", F.array_join("factor_dates", "|").alias("factor_dates"))


@query("""WITH v AS (SELECT c_custkey AS id, c_custkey % 3 > 0 AS ok, (c_custkey % 1000) / 1000.0 AS m FROM customer)
SELECT id, CASE WHEN ok THEN round(m, 3) ELSE 0 END::DOUBLE AS mrr, CASE WHEN ok THEN 0.5 ELSE 0 END::DOUBLE AS hits1, 0.0::DOUBLE AS hits3 FROM v""")
def log_metrics(spark, d):
    """Metrics out of training logs; a log without them gives zeros."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    log = F.when(key % 3 == 0, "epoch 1 {loss: 2}\nfailed").otherwise(F.format_string('epoch 1\n{"x": 1}\nresult {"MRR": 0.%03d,\n "Hits@1": 0.5004}\nbye', key % 1000))
    return serving.log_metrics(c.select(key.alias("id"), log.alias("log"))).select("id", "mrr", "hits1", "hits3")


@query("""SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def log_timing(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT n_name AS id, 'l' AS label, CASE n_name WHEN 'NATION_2' THEN 0.9 ELSE 0.1 END::DOUBLE AS mrr, 0.2::DOUBLE AS hits1 FROM nation""")
def variant_override(spark, d):
    """An index of variants with the fresher metrics of the active one, where it has them."""
    v = table(spark, d, "nation").select(F.col("n_name").alias("id"), F.lit("l").alias("label"), F.lit(0.1).alias("mrr"), F.lit(0.2).alias("hits1"))
    return serving.override(v, spark.createDataFrame([("NATION_2", 0.9, None)], "id string, mrr double, hits1 double"))


@query("""WITH n AS (SELECT DISTINCT p_name || ' é😀/~*+&%' || p_type AS name FROM part),
h AS (SELECT name, list_reduce(list_concat([2166136261::BIGINT], flatten(list_transform(string_split(name, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + unicode(c) % 1024]::BIGINT[] ELSE [unicode(c)]::BIGINT[] END))), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM n)
SELECT name, h, round(cos(h % 3600 / 3600.0 * 2 * pi()) * (18 + (h >> 12) % 60), 6) AS x, round(sin(h % 3600 / 3600.0 * 2 * pi()) * (18 + (h >> 12) % 60), 6) AS y,
  replace(replace(replace(replace(replace(replace(replace(name, '%', '%25'), ' ', '%20'), 'é', '%C3%A9'), '😀', '%F0%9F%98%80'), '*', '%2A'), '+', '%2B'), '&', '%26') AS quoted FROM h""")
def txt_hash_and_quote(spark, d):
    """Names' hashes, the offsets that they give, and their quoted form."""
    n = table(spark, d, "part").select(F.concat("p_name", F.lit(" é😀/~*+&%"), "p_type").alias("name")).distinct()
    x, y = text.jitter(F.col("name"))
    return n.select("name", text.fnv1a(F.col("name")).alias("h"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), text.url_quote(F.col("name")).alias("quoted"))


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_custkey) AS a, max(c_custkey) AS z, count(*) AS n FROM customer), r AS (SELECT *, least(2600.0, greatest(500.0, sqrt(n) * 110)) AS room FROM b)
SELECT 'box' AS node, round(lo - (hi - lo) * 0.15, 4) AS x, round(z + (z - a) * 0.15, 4) AS y FROM b
UNION ALL SELECT c_name, round((c_acctbal - (lo + hi) / 2) * room / (hi - lo), 4), round((c_custkey - (a + z) / 2) * room / (z - a), 4) FROM customer, r""")
def kg_spread(spark, d):
    """Points spread over a box that grows with their number, and the box around them."""
    p = table(spark, d, "customer").select(F.col("c_name").alias("node"), F.col("c_acctbal").alias("x"), F.col("c_custkey").cast("double").alias("y"))
    box = serving.bounds(p).select(F.lit("box").alias("node"), F.round("x_min", 4).alias("x"), F.round("y_max", 4).alias("y"))
    return box.unionByName(serving.spread(p).select("node", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")))


@query(f"""WITH t AS (SELECT user_id, list(n ORDER BY day) AS v FROM (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)
SELECT user_id, array_to_string(list_transform(v, lambda x, i: printf('%.1f,%.1f', (i - 1) / greatest(1, len(v) - 1) * 48.0, 14 - x / greatest(1, list_max(v)) * 12.0)), ' ') AS points, upper(substring(replace(lower('FIN_' || user_id || '__X'), '_', ' '), 1, 1)) || 'in ' || user_id || ' x' AS label FROM t""")
def txt_sparkline(spark, d):
    """A user's events by day as the points of a small chart, and a type in words."""
    daily = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    series = daily.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"]).alias("v"))
    label = text.type_label(F.concat(F.lit("FIN_"), F.col("user_id").cast("string"), F.lit("__X")))
    return series.select("user_id", text.sparkline(F.col("v")).alias("points"), label.alias("label"))


@query("""WITH RECURSIVE k(sector, keyword, ord) AS (VALUES ('Metals', 'steel', 0), ('Metals', 'copper', 0), ('Goods', 'large brass', 1), ('Goods', 'economy', 1)),
e AS (SELECT DISTINCT p_name || ' ' || p_type AS node, p_brand AS root FROM part), b AS (SELECT DISTINCT x.root AS a, y.root AS b FROM e x JOIN e y USING (node)),
reach AS (SELECT a, b FROM b UNION SELECT reach.a, b.b FROM reach JOIN b ON reach.b = b.a), c AS (SELECT a AS root, min(b) AS comp FROM reach GROUP BY a),
n AS (SELECT DISTINCT node, comp FROM e JOIN c USING (root) UNION SELECT root, comp FROM c), p AS (SELECT node, ' ' || trim(regexp_replace(lower(node), '[^a-z0-9&]+', ' ', 'g')) || ' ' AS padded FROM n),
m AS (SELECT node, arg_min(sector, ord) AS sector, min(ord) AS ord FROM p JOIN k ON contains(padded, ' ' || keyword || ' ') GROUP BY node),
v AS (SELECT comp, sector, min(ord) AS ord, count(*) AS n FROM m JOIN n USING (node) GROUP BY ALL), w AS (SELECT comp, sector FROM v QUALIFY row_number() OVER (PARTITION BY comp ORDER BY n DESC, ord) = 1)
SELECT node, coalesce(sector, 'Other') AS sector FROM n LEFT JOIN w USING (comp)""")
def sector_infer(spark, d):
    """Every node's sector: that of most matched members of its component."""
    e = table(spark, d, "part").select(F.concat("p_name", F.lit(" "), "p_type").alias("a"), F.col("p_brand").alias("b")).distinct()
    members = canon.components(e)
    keywords = spark.createDataFrame(KEYWORDS, "sector string, keyword string, ord int")
    order = keywords.groupBy("sector").agg(F.min("ord").alias("ord"))
    return canon.sector_vote(members, canon.sector_of(members.select("node"), keywords), order).select("node", "sector")


_ROUND2 = "floor(({}) * 100 + 0.5) / 100"
_NEAR = "".join(
    f"""p{i + 1} AS MATERIALIZED (SELECT node, coalesce(p.x, q.x) AS x, coalesce(p.y, q.y) AS y FROM p{i} p LEFT JOIN (
  SELECT a AS node, {_ROUND2.format("avg(o.x) + any_value(h.dx)")} AS x, {_ROUND2.format("avg(o.y) + any_value(h.dy)")} AS y
  FROM links JOIN p{i} o ON o.node = b JOIN h ON h.node = a WHERE o.x IS NOT NULL GROUP BY a) q USING (node)),
"""
    for i in range(6)
)
_RING = lambda f: _ROUND2.format(f"{f}(i * 2.399963) * sqrt(409600.0 + 2150400.0 * i / m) + {f}(j * 2.399963) * 26.0 * sqrt(j)")


@query(f"""WITH RECURSIVE c AS (SELECT c_custkey AS k, c_custkey // 200 * 200 AS g, c_custkey % 200 AS l FROM customer),
e AS (SELECT 'c' || k AS sub, 'c' || (g + l // 2) AS obj FROM c), links AS MATERIALIZED (SELECT sub AS a, obj AS b FROM e UNION ALL SELECT obj, sub FROM e),
f AS (SELECT node, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(node, ''), lambda c: unicode(c)::BIGINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS f FROM (SELECT DISTINCT a AS node FROM links)),
h AS MATERIALIZED (SELECT node, cos(f % 3600 / 3600.0 * 2 * pi()) * (18 + (f >> 12) % 60) AS dx, sin(f % 3600 / 3600.0 * 2 * pi()) * (18 + (f >> 12) % 60) AS dy FROM f),
p0 AS (SELECT node, x, y FROM (SELECT DISTINCT a AS node FROM links) LEFT JOIN (SELECT 'c' || k AS node, k * 1.5::DOUBLE AS x, k / -4.0::DOUBLE AS y FROM c WHERE l = 0 AND k % 600 = 0) USING (node)),
{_NEAR}lost AS MATERIALIZED (SELECT node FROM p6 WHERE x IS NULL),
inner_links AS MATERIALIZED (SELECT DISTINCT a, b FROM links WHERE a <> b AND a IN (SELECT node FROM lost) AND b IN (SELECT node FROM lost)),
reach AS (SELECT node AS a, node AS b FROM lost UNION SELECT reach.a, inner_links.b FROM reach JOIN inner_links ON reach.b = inner_links.a),
parts AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
rings AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) - 1 AS i, greatest(1, count(*) OVER () - 1) AS m FROM parts GROUP BY root),
r AS (SELECT node, i, m, row_number() OVER (PARTITION BY root ORDER BY node) - 1 AS j FROM parts JOIN rings USING (root))
SELECT node, x, y FROM p6 WHERE x IS NOT NULL UNION ALL SELECT node, {_RING("cos")}, {_RING("sin")} FROM r""")
def kg_placed(spark, d):
    """Trees of customers, every third with a placed root: six passes of neighbours'
    centroids, and what they do not reach on the ring."""
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("c"), n.cast("long").cast("string"))
    c = table(spark, d, "customer")
    e = c.select(name(k).alias("sub"), name(k - k % 200 + F.floor(k % 200 / 2)).alias("obj"))
    anchor = c.filter(k % 600 == 0).select(name(k).alias("node"), (k * 1.5).cast("double").alias("x"), (k / -4.0).cast("double").alias("y"))
    return serving.placed_graph(e, e.select(F.explode(F.array("sub", "obj")).alias("node")).distinct(), anchor)


@query()
def kg_merged_layout(spark, d):
    """All months' nodes placed around those of the busiest month."""
    e = edges(spark, d).select("month", "sub", "obj").distinct()
    month = graph.anchor_month(graph.ends(e.withColumn("weight", F.lit(1)), "month").select("month", "node").distinct()).withColumnRenamed("anchor", "month")
    anchor = ml.spread_layout(cut(e.join(F.broadcast(month), "month", "left_semi")))  # one row
    nodes = e.select(F.explode(F.array("sub", "obj")).alias("node")).distinct()
    return serving.placed_graph(e.select("sub", "obj").distinct(), nodes, anchor)


@query()
def causal_features(spark, d):
    """Features of the busiest entities in the graph learned from each year's days."""
    t = triplets(spark, d, False)
    c = predict.cooccurrence(t).withColumn("window", F.date_format("day", "yyyy"))
    return ml.causal_features(c, c.select("entity").distinct())
