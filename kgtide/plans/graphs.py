"""Queries on the monthly graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import canon, graph
from ..operators.lineage import cut, dealt
from ..sources.adapter import TRIPLETS_SQL, table, triplets
from .registry import query

W = f"WITH {TRIPLETS_SQL}"
EDGES = f'{W}, edges AS (SELECT "month", sub, obj, rel, rel_category, count(*) AS weight FROM triplets GROUP BY ALL)'
#: A month range for the range queries, and the entity for the node queries.
FIRST, LAST, NODE = "1995-01", "1996-06", "Brand#13"


def dealt_triplets(spark, d, *keys):
    """Triplets without event types, dealt by keys over tasks of bounded rows."""
    return dealt(triplets(spark, d, False), table(spark, d, "lineitem").count(), *keys)


def edges(spark, d):
    """Monthly edges; those of two ends are in one task, so further groupings by ends need no shuffle."""
    return graph.month_edges(dealt_triplets(spark, d, "sub", "obj"))


def family_sql(variant: str, c: str = "lower(rel)") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{text.any_of(words)}') THEN '{family}'" for family, words in vocab.FAMILIES[variant]) + " ELSE 'OTHER' END"


def hit_sql(words, c: str = "lower(rel)") -> str:
    return f"regexp_matches({c}, '{text.any_of(words)}')"


@query(f'{EDGES} SELECT * FROM edges')
def kg_month_edges(spark, d):
    return edges(spark, d)


@query(f"""{W}, t AS (SELECT "month", sub, rel, obj, count(*) AS weight, avg(sentiment) AS s, coalesce(sum(materiality_usd) FILTER (materiality_usd > 0), 0)::DOUBLE AS materiality_usd,
  arg_max(rel_category, (url, seq)) AS rel_category FROM triplets GROUP BY ALL),
e AS (SELECT "month", sub, rel, obj, event_type, count(*) AS n, min((url, seq)) AS first FROM triplets GROUP BY ALL),
p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY "month", sub, rel, obj ORDER BY n DESC, first) = 1)
SELECT t."month", t.sub, t.rel, t.obj, weight, materiality_usd, rel_category, round(s, 4) AS sentiment, round(ln(1 + materiality_usd), 4) AS materiality_log,
  CASE WHEN round(s, 6) > 0.15 THEN 'positive' WHEN round(s, 6) < -0.15 THEN 'negative' ELSE 'neutral' END AS polarity, event_type
FROM t JOIN p USING ("month", sub, rel, obj)""")
def kg_enriched_edges(spark, d):
    return graph.enriched_edges(triplets(spark, d))


@query(f'{EDGES} SELECT "month", node, sum(weight)::BIGINT AS degree FROM (SELECT "month", sub AS node, weight FROM edges UNION ALL SELECT "month", obj, weight FROM edges) GROUP BY ALL')
def kg_degree_weighted(spark, d):
    return graph.weighted_degree(edges(spark, d), "month")


@query(f"""{W}, p AS (SELECT DISTINCT "month", sub, obj FROM triplets)
SELECT "month", node, count(*) AS degree FROM (SELECT "month", sub AS node FROM p UNION ALL SELECT "month", obj FROM p) GROUP BY ALL""")
def kg_degree_distinct(spark, d):
    return graph.distinct_degree(triplets(spark, d, False), "month")


TYPED = "CASE regexp_replace(upper({0}), '[^A-Z]', '', 'g') WHEN 'STOCKTICKER' THEN 'STOCKTICKER' WHEN 'COMPANY' THEN 'COMPANY' WHEN 'PRODUCT' THEN 'PRODUCT' ELSE 'UNK' END"
OCC = f"""{W}, occ AS (
  SELECT "month", url, seq, 0 AS side, sub AS node, {TYPED.format("sub_type")} AS type FROM triplets
  UNION ALL SELECT "month", url, seq, 1, obj, {TYPED.format("obj_type")} FROM triplets)"""


@query(f"""{OCC} SELECT "month", node, arg_min(type, (type = 'UNK', url, seq, side)) AS type FROM occ GROUP BY ALL""")
def kg_node_type_first_known(spark, d):
    return graph.node_types(triplets(spark, d, False), "first_known", "month")


@query(f"""{OCC} SELECT "month", node, arg_min(type, (url, seq, side)) AS type FROM occ GROUP BY ALL""")
def kg_node_type_first(spark, d):
    return graph.node_types(triplets(spark, d, False), "first", "month")


@query(f"""{OCC} SELECT "month", node, arg_max(type, (url, seq, side)) AS type FROM occ GROUP BY ALL""")
def kg_node_type_last(spark, d):
    return graph.node_types(triplets(spark, d, False), "last", "month")


@query(f"""{OCC}, c AS (SELECT node, type, count(*) AS n, min((url, seq, side)) AS first FROM occ GROUP BY ALL)
SELECT node, type FROM c QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, first) = 1""")
def kg_node_type_majority(spark, d):
    return graph.node_types(triplets(spark, d, False), "majority")


@query(f"""{W}, r AS (SELECT rel, count(*) AS n FROM triplets GROUP BY rel)
SELECT rel, n, {family_sql("historical")} AS historical, {family_sql("live")} AS live, {family_sql("enriched")} AS enriched,
  CASE WHEN {hit_sql(vocab.NEGATIVE)} AND NOT {hit_sql(vocab.POSITIVE)} THEN 'negative' WHEN {hit_sql(vocab.POSITIVE)} AND NOT {hit_sql(vocab.NEGATIVE)} THEN 'positive' ELSE 'neutral' END AS polarity,
  CASE WHEN {hit_sql(vocab.LIVE_NEGATIVE)} THEN 'negative' WHEN {hit_sql(vocab.LIVE_POSITIVE)} THEN 'positive' ELSE 'neutral' END AS live_polarity
FROM r""")
def kg_causal_families(spark, d):
    r = triplets(spark, d, False).groupBy("rel").agg(F.count("*").alias("n"))
    rel = F.col("rel")
    return r.select("rel", "n", *(text.causal_family(rel, v).alias(v) for v in vocab.FAMILIES), text.polarity(rel).alias("polarity"), text.polarity(rel, "live").alias("live_polarity"))


def _text_words(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("rel"))


@query(f"""SELECT conv_id, turn, {family_sql("historical", "lower(coalesce(text, ''))")} AS family,
  CASE WHEN {hit_sql(vocab.LIVE_NEGATIVE, "lower(coalesce(text, ''))")} THEN 'negative' WHEN {hit_sql(vocab.LIVE_POSITIVE, "lower(coalesce(text, ''))")} THEN 'positive' ELSE 'neutral' END AS polarity FROM conversations""")
def kg_classify_texts(spark, d):
    r = _text_words(spark, d)
    return r.select("conv_id", "turn", text.causal_family(F.col("rel")).alias("family"), text.polarity(F.col("rel"), "live").alias("polarity"))


@query(f"""{EDGES} SELECT sub, obj, rel, rel_category, sum(weight)::BIGINT AS weight, min("month") AS first_month, count(DISTINCT "month") AS n_months
FROM edges WHERE "month" BETWEEN '{FIRST}' AND '{LAST}' GROUP BY ALL""")
def kg_range_merge(spark, d):
    return graph.range_merge(edges(spark, d), LAST, FIRST)


@query(f"""{EDGES}, m AS (SELECT sub, obj, rel, rel_category, sum(weight)::BIGINT AS weight FROM edges WHERE "month" BETWEEN '{FIRST}' AND '{LAST}' GROUP BY ALL)
SELECT *, 'm' || (row_number() OVER (ORDER BY sub, obj, rel, rel_category) - 1) AS id FROM m""")
def kg_merged_ids(spark, d):
    m = graph.range_merge(edges(spark, d), FIRST, LAST).drop("first_month", "n_months")
    return graph.with_ids(m, "m", "sub", "obj", "rel", "rel_category").select("sub", "obj", "rel", "rel_category", "weight", "id")


PAIR = """SELECT sub, rel, obj, count(*) AS weight, round(avg(sentiment), 4) AS sentiment, coalesce(sum(materiality_usd) FILTER (materiality_usd > 0), 0)::DOUBLE AS materiality_usd FROM triplets WHERE "month" = '{}' GROUP BY ALL"""


@query(f"""{W}, a AS ({PAIR.format("1995-03")}), b AS ({PAIR.format("1995-04")})
SELECT sub, rel, obj, (coalesce(a.weight, 0) + coalesce(b.weight, 0))::BIGINT AS weight,
  round(CASE WHEN a.weight IS NOT NULL AND b.weight IS NOT NULL THEN (a.sentiment + b.sentiment) / 2 ELSE coalesce(a.sentiment, b.sentiment) END, 4) AS sentiment,
  greatest(a.materiality_usd, b.materiality_usd) AS materiality_usd
FROM a FULL JOIN b USING (sub, rel, obj)""")
def kg_pair_merge(spark, d):
    e = graph.enriched_edges(triplets(spark, d).filter(F.col("month").isin("1995-03", "1995-04")))
    return graph.pair_merge(e.filter("month = '1995-03'"), e.filter("month = '1995-04'"))


@query(f"""{EDGES} SELECT * FROM edges""")
def kg_corpus_upsert(spark, d):
    t = triplets(spark, d, False)
    return graph.corpus_upsert(graph.month_edges(t.filter("seq % 2 = 0")), t.filter("seq % 2 = 1"))


NODES = 'SELECT "month", sub AS node FROM edges UNION ALL SELECT "month", obj FROM edges'


@query(f"""{EDGES} SELECT * FROM (SELECT "month", count(*) AS edges, sum(weight)::BIGINT AS weight FROM edges GROUP BY ALL) JOIN (SELECT "month", count(DISTINCT node) AS nodes FROM ({NODES}) GROUP BY ALL) USING ("month")""")
def kg_snapshot_stats(spark, d):
    return graph.snapshot_stats(edges(spark, d))


@query(f"""{EDGES} SELECT "month", count(*) AS n FROM edges GROUP BY "month" HAVING count(*) >= 700 OR "month" = '1998-12'""")
def kg_index_months(spark, d):
    return graph.index_months(edges(spark, d), "1998-12", 700)


LATEST = "SELECT * FROM edges WHERE \"month\" = (SELECT max(\"month\") FROM edges WHERE \"month\" <= '1998-06')"
DEG = "deg AS (SELECT node, sum(weight)::BIGINT AS degree FROM (SELECT sub AS node, weight FROM snap UNION ALL SELECT obj, weight FROM snap) GROUP BY node)"


def latest(spark, d):
    e = edges(spark, d).filter("month <= '1998-06'")
    last = e.agg(F.max("month").alias("month"))
    return e.join(F.broadcast(last), "month", "left_semi")  # one row


@query(f"""{EDGES}, snap AS ({LATEST}), {DEG}, top AS (SELECT node FROM deg ORDER BY degree DESC, node LIMIT 40)
SELECT * FROM snap WHERE sub IN (SELECT node FROM top) AND obj IN (SELECT node FROM top) ORDER BY weight DESC, sub, obj, rel, rel_category LIMIT 200""")
def kg_top_graph(spark, d):
    return graph.top_graph(latest(spark, d))


@query(f"""{EDGES}, snap AS ({LATEST}), {DEG} SELECT * FROM deg WHERE degree >= (SELECT greatest(1, floor(30 / 100.0 * max(degree) + 0.5)) FROM deg)""")
def kg_min_degree_filter(spark, d):
    return graph.min_degree(graph.weighted_degree(latest(spark, d)), 30)


@query(f"""{W}, snap AS (SELECT sub, url AS obj, 1 AS weight FROM triplets WHERE "month" = '1996-01'), {DEG},
lim AS (SELECT min(degree) AS least FROM (SELECT degree FROM deg ORDER BY degree DESC LIMIT 300)),
o AS (SELECT count(*) FILTER (degree >= least) AS over, any_value(least) AS least, count(*) AS n, max(degree) AS top FROM deg, lim)
SELECT n, CASE WHEN n <= 200 THEN 5 ELSE greatest(1, least(20, ceil(100.0 * (least + CASE WHEN over > 450 THEN 1 ELSE 0 END) / top)))::BIGINT END AS percent FROM o""")
def kg_auto_threshold(spark, d):
    e = triplets(spark, d, False).filter("month = '1996-01'").select("sub", F.col("url").alias("obj"), F.lit(1).alias("weight"))
    return graph.auto_threshold(graph.weighted_degree(e))


@query(f"""{EDGES}, snap AS ({LATEST}), {DEG}, vis AS (SELECT node FROM deg WHERE degree >= 4)
SELECT sub, obj, rel, weight FROM snap WHERE {family_sql("historical")} IN ('REGULATORY', 'COMPETITIVE', 'CAUSAL') AND sub IN (SELECT node FROM vis) AND obj IN (SELECT node FROM vis)""")
def kg_visible_edges(spark, d):
    e = latest(spark, d)
    return graph.visible_edges(e, graph.weighted_degree(e).filter("degree >= 4"), ["REGULATORY", "COMPETITIVE", "CAUSAL"]).select("sub", "obj", "rel", "weight")


@query("""WITH c AS (SELECT source AS type, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT type, n FROM (SELECT *, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, type) AS rn FROM c) WHERE share >= 0.05 OR rn <= 6""")
def kg_type_tail(spark, d):
    c = spark.read.parquet(f"{d}/documents.parquet").filter("source is not null").groupBy(F.col("source").alias("type")).agg(F.count("*").alias("n"))
    return graph.long_tail(c, 0.05)


@query(f"""{EDGES}, snap AS ({LATEST}) SELECT 'out' AS side, obj AS other, rel, weight FROM snap WHERE sub = '{NODE}' UNION ALL SELECT 'in', sub, rel, weight FROM snap WHERE obj = '{NODE}'""")
def kg_node_detail(spark, d):
    return graph.node_detail(latest(spark, d), NODE)


@query(f"""{EDGES}, snap AS ({LATEST}), near AS (SELECT sub AS node FROM snap WHERE obj = '{NODE}' OR sub = '{NODE}' UNION SELECT obj FROM snap WHERE obj = '{NODE}' OR sub = '{NODE}')
SELECT DISTINCT node, node IN (SELECT node FROM near) AS near FROM (SELECT sub AS node FROM snap UNION ALL SELECT obj FROM snap)""")
def kg_neighborhood(spark, d):
    return graph.neighbourhood(latest(spark, d), NODE)


@query(f"""{EDGES} SELECT DISTINCT least(sub, obj) AS a, greatest(sub, obj) AS b FROM edges WHERE sub <> obj""")
def kg_undirected_links(spark, d):
    return graph.undirected(edges(spark, d))


@query(f"""{EDGES}, n AS (SELECT DISTINCT "month", node FROM ({NODES})), c AS (SELECT "month", count(*) AS n FROM n GROUP BY ALL) SELECT "month" AS anchor FROM c ORDER BY n DESC, "month" DESC LIMIT 1""")
def kg_anchor_month(spark, d):
    e = edges(spark, d)
    return graph.anchor_month(graph.ends(e, "month").select("month", "node").distinct())


@query("""WITH RECURSIVE l AS (SELECT s_name AS s, 'part ' || l_partkey AS p, count(*) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE strftime(l_shipdate, '%Y-%m') BETWEEN '1995-01' AND '1995-03' GROUP BY ALL),
near AS (SELECT DISTINCT x.s AS a, y.s AS b FROM l x JOIN l y USING (p)), reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
c AS (SELECT a AS s, min(b) AS root FROM reach GROUP BY a), part_of AS (SELECT s AS node, root FROM c UNION ALL SELECT DISTINCT p, root FROM l JOIN c USING (s)),
deg AS (SELECT node, sum(w)::BIGINT AS degree FROM (SELECT s AS node, w FROM l UNION ALL SELECT p, w FROM l) GROUP BY node),
t AS (SELECT *, count(*) OVER () AS n, (SELECT count(DISTINCT root) FROM c) AS parts FROM deg JOIN part_of USING (node)),
r AS (SELECT *, row_number() OVER (ORDER BY degree DESC, node) AS rn, row_number() OVER (PARTITION BY root ORDER BY degree DESC, node) AS own FROM t)
SELECT node, degree FROM r WHERE n <= 220 OR parts >= 8 OR rn <= greatest(80, floor(0.4 * n + 0.5)) OR own = 1""")
def kg_label_budget(spark, d):
    """Labelled nodes of a quarter's graph of suppliers and parts, among them the top
    of each of its components."""
    line = table(spark, d, "lineitem").filter(F.date_format("l_shipdate", "yyyy-MM").between("1995-01", "1995-03"))
    e = line.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_name").alias("sub"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("obj")).agg(F.count("*").alias("weight"))
    e = cut(e)
    parts = canon.components(e.select(F.col("sub").alias("a"), F.col("obj").alias("b")))
    return graph.label_budget(graph.weighted_degree(e).join(parts, "node"), F.col("root")).select("node", "degree")


@query(f"""{W} SELECT strftime("day", '%Y') AS "year", event_type, count(*) AS n, count(DISTINCT url) AS n_articles FROM triplets GROUP BY ALL""")
def kg_facets(spark, d):
    return triplets(spark, d).groupBy(F.date_format("day", "yyyy").alias("year"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_articles"))


@query(f"""{EDGES} SELECT "month", substring("month", 1, 4) <> coalesce(lag(substring("month", 1, 4)) OVER (ORDER BY "month"), '') AS new_year, (row_number() OVER (ORDER BY "month") - 1) % 3 = 0 AS labelled FROM (SELECT DISTINCT "month" FROM edges)""")
def kg_timeline(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy("month")  # a row for each month
    year = F.substring("month", 1, 4)
    return edges(spark, d).select("month").distinct().select("month", (year != F.coalesce(F.lag(year).over(w), F.lit(""))).alias("new_year"), ((F.row_number().over(w) - 1) % 3 == 0).alias("labelled"))
