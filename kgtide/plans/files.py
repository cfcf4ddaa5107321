"""Queries that write files and tables to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from ..operators.lineage import cut, dealt, scratch
from ..sources import bundles, readers, writers
from ..sources.adapter import ARTICLES_SQL, TRIPLETS_SQL, articles, table, triplets
from ..streaming import ingest
from .analytics import KINDS, LEAD, important
from .graphs import EDGES, edges
from .registry import query

W = f"WITH {TRIPLETS_SQL}"
TODAY = "2022-01-31"
#: Articles in one CSV file.
ARTICLES_A_FILE = 50_000


def _article_csv(spark: SparkSession, d: str) -> str:
    """Orders as article rows of a CSV with quoted line breaks and bad cells."""
    k, key = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    cust = F.concat(F.lit("Cust "), F.col("o_custkey").cast("string"))
    items = F.concat(F.lit("[('"), cust, F.lit("', 'COMPANY', 'Buys', 'SSI', '"), F.col("o_orderpriority"), F.lit("', 'CONCEPT'), ('bad', 5),\n ('  "), cust, F.lit("', None, 'Sells \"it\", again', 'GMM', 'x, y', 'nan')]"))
    cell = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, "not a list").when(k % 13 == 0, "[('a', 'b'").otherwise(items)
    date = F.when(k % 5 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" 00:00:00 UTC")))
    title = F.when(k % 3 > 0, F.concat(F.lit('Order "'), key, F.lit('", by '), cust))
    rows = table(spark, d, "orders").select(
        date.alias("date"), title.alias("title"), F.lit("").alias("ticker"), F.concat(F.lit("order://"), key).alias("url"), F.repeat(cust, 200).alias("text"), F.lit(None).cast("string").alias("summary"), cell.alias("output_triplets"),
    )
    path = scratch(spark, "articles")
    # A file with quoted line breaks is read by one task, so files are bounded; texts compress well.
    rows.write.option("header", True).option("escape", '"').option("compression", "gzip").option("maxRecordsPerFile", ARTICLES_A_FILE).csv(path)
    return path


@query("""WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS "month", 'Cust ' || o_custkey AS sub, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0 AND o_orderkey % 13 > 0)
SELECT "month", sub, p AS obj, 'Buys' AS rel, 'SSI' AS rel_category, count(*) AS weight FROM o GROUP BY ALL
UNION ALL SELECT "month", sub, 'x, y', 'Sells "it", again', 'GMM', count(*) FROM o GROUP BY ALL""")
def src_csv_triplets(spark, d):
    """Article CSV to monthly edges."""
    return readers.csv_edges(spark, _article_csv(spark, d))


@query("""SELECT 'order://' || o_orderkey AS url, CASE WHEN o_orderkey % 3 > 0 THEN 'Order "' || o_orderkey || '", by Cust ' || o_custkey ELSE '' END AS title, '' AS summary, substring(repeat('Cust ' || o_custkey, 200), 1, 1000) AS text FROM orders""")
def src_csv_articles(spark, d):
    """Article CSV with nulls as empty strings, texts cut to 1,000 characters."""
    rows = readers.require(readers.read_articles(spark, _article_csv(spark, d)), ["date", "url", "output_triplets"])
    return rows.select("url", "title", "summary", F.substring("text", 1, 1000).alias("text"))


@query("""SELECT 'order://' || o_orderkey AS url FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-02-03' AND '1996-01-31' AND o_orderkey % 5 > 0""")
def src_date_slice(spark, d):
    return readers.slice_dates(readers.read_articles(spark, _article_csv(spark, d)), "1995-02-03", "1996-01-31").select("url")


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name FROM supplier WHERE s_suppkey % 5 <> 2")
def src_csv_tolerant(spark, d):
    """Lines with too many cells are left out."""
    s = table(spark, d, "supplier")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name", F.when(F.col("s_suppkey") % 5 == 2, "one,more"))
    path = scratch(spark, "lines")
    s.select(line.alias("value")).write.text(path)
    return readers.read_tolerant(spark, path, "id string, name string")


MONTH_EDGES = "sub string, obj string, rel string, rel_category string, weight long"


@query(f"{EDGES} SELECT * FROM edges")
def src_month_json(spark, d):
    """Months as JSON documents, the month in the path; a missing month is empty."""
    path = scratch(spark, "json")
    edges(spark, d).write.partitionBy("month").json(path)
    missing = readers.read_month(spark, path, "2030-01", f"{MONTH_EDGES}, month string")
    return readers.read_month_json(spark, path, MONTH_EDGES).unionByName(missing)


def _months(spark: SparkSession, d: str) -> str:
    """Monthly edges, of which one month is written three times, at last with double weights."""
    path, e = scratch(spark, "months"), edges(spark, d)
    readers.write_months(e, path)
    for _ in range(2):
        readers.write_months(e.filter("month = '1995-03'").withColumn("weight", 2 * F.col("weight")), path)
    return path


@query(f"""{EDGES}, m AS (SELECT DISTINCT "month" FROM edges ORDER BY "month" DESC LIMIT 3)
SELECT "month", sub, obj, rel, rel_category, CASE WHEN "month" = '1995-03' THEN 2 * weight ELSE weight END AS weight FROM edges WHERE "month" = '1995-03' OR "month" IN (SELECT "month" FROM m)""")
def src_last_months(spark, d):
    """A month that was replaced, and the last three that exist."""
    path = _months(spark, d)
    one = readers.read_month(spark, path, "1995-03", f"{MONTH_EDGES}, month string")
    return readers.read_months(spark, path, f"{MONTH_EDGES}, month string", 3).filter("month <> '1995-03'").unionByName(one)


@query(f"""{EDGES} SELECT "month", "month" = max("month") OVER () AS latest FROM (SELECT DISTINCT "month" FROM edges)""")
def snk_month_index(spark, d):
    return writers.month_index(spark, _months(spark, d))


FEED = "doc_id // 40"


def _feeds(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of forty documents each; every ninth is broken."""
    i, key = F.col("doc_id"), F.col("doc_id").cast("string")
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>\n"))
    day = F.date_add(F.lit("2021-03-01").cast("date"), (i % 200).cast("int"))
    date = F.when(i % 4 == 0, "some day").otherwise(F.concat(F.date_format(day, "E, dd MMM yyyy"), F.lit(" 23:30:00 -0200")))
    item = F.concat(
        F.lit('<item id="x">\n'), tag("title", F.when(i % 3 == 0, F.concat(F.lit("<![CDATA[Doc <"), key, F.lit(">]]>"))).otherwise(F.concat(F.lit("Doc &amp; "), key))),
        tag("link", F.concat(F.lit("http://x/"), key)), tag("pubDate", date), F.when(i % 2 == 0, tag("source", F.col("lang"))).otherwise(""), F.when(i % 5 == 0, tag("description", F.lit("a &lt;b&gt;"))).otherwise(""), F.lit("</item>"),
    )
    feeds = table(spark, d, "documents").filter("doc_id is not null").groupBy(F.floor(i / 40).alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"]), "\n").alias("items"))
    whole = F.concat(F.lit("<rss><channel><title>Feed "), F.col("feed").cast("string"), F.lit("</title>"), F.col("items"), F.when(F.col("feed") % 9 == 4, "<item>").otherwise("</channel></rss>"))
    return feeds.select("feed", whole.alias("xml"))


ITEMS = f"""i AS (SELECT doc_id, {FEED} AS feed, (row_number() OVER (PARTITION BY {FEED} ORDER BY doc_id) - 1)::INT AS ord, lang FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT feed, ord, CASE WHEN doc_id % 3 = 0 THEN 'Doc <' || doc_id || '>' ELSE 'Doc & ' || doc_id END AS title, 'http://x/' || doc_id AS url,
  CASE WHEN doc_id % 2 = 0 THEN 'google_news:' || lang ELSE 'google_news' END AS source, CASE WHEN doc_id % 4 = 0 THEN DATE '{TODAY}' ELSE DATE '2021-03-01' + (doc_id % 200)::INT + 1 END AS date,
  doc_id % 5 = 0 AS described FROM i WHERE ord < 25 AND feed % 9 <> 4)"""


@query(f"""WITH {ITEMS} SELECT feed, ord, title, url, source, date, CASE WHEN described THEN 'a <b>' ELSE title END AS text FROM f
UNION ALL SELECT DISTINCT feed, -1, 'broken', NULL, NULL, NULL, NULL FROM i WHERE feed % 9 = 4""")
def src_news_feeds(spark, d):
    """Items of news feeds, and the feeds that are broken."""
    raw = _feeds(spark, d)
    items = readers.rss_items(raw, F.lit(TODAY).cast("date"), 25, news=True)
    return items.unionByName(readers.broken_feeds(raw).select("feed", F.lit(-1).alias("ord"), F.lit("broken").alias("title")), allowMissingColumns=True)


@query(f"""WITH {ITEMS} SELECT 'Feed ' || feed AS source, count(*) AS n FROM f GROUP BY feed""")
def src_rss_feeds(spark, d):
    return readers.rss_items(_feeds(spark, d), F.lit(TODAY).cast("date"), 25).groupBy("source").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT n_name FROM nation),
g AS (SELECT 'google_news' AS source, n_name AS item, 'stock' AS terms FROM t UNION ALL SELECT 'yahoo_finance', n_name, 'stock' FROM t UNION ALL SELECT 'google_news', 'A & B/C', ''
  UNION ALL SELECT 'rss_feeds', 'http://f/1', NULL)
SELECT source, item, terms, CASE source WHEN 'google_news' THEN 'https://news.google.com/rss/search?q=' || CASE WHEN terms = '' THEN 'A%20%26%20B/C' ELSE item || '%20stock' END || CASE WHEN terms = '' THEN '&hl=de&gl=DE&ceid=DE:de' ELSE '&hl=en&gl=US&ceid=US:en' END
  WHEN 'rss_feeds' THEN item END AS url FROM g""")
def src_watchlist(spark, d):
    """A YAML watchlist as the fetches that it asks for."""
    names = [r["n_name"] for r in table(spark, d, "nation").select("n_name").collect()]  # the lines of a watchlist
    lines = ["corpus: x", "sources: [google_news, yahoo_finance, rss_feeds, other]", "rss_feeds: ['http://f/1']", "extra_google_queries: {terms: ['A & B/C'], region: DE, lang: de}", "tickers:", *(f"  - {n}" for n in names)]
    return readers.fetch_plan(spark, "\n".join(lines)).select("source", "item", "terms", "url")


CONSTITUENTS = """c AS (SELECT 'T' || c_custkey % 700 AS ticker, c_name AS company, CASE c_nationkey % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'France' ELSE 'Atlantis' END AS country FROM customer WHERE c_custkey % 11 > 0 AND c_custkey % 13 > 0),
u AS (SELECT ticker, min((country, company)) AS x FROM c GROUP BY ticker),
w AS (SELECT ticker, x[1] AS country, x[2] AS company, ticker || CASE x[1] WHEN 'Germany' THEN '.DE' WHEN 'France' THEN '.PA' ELSE '' END AS yahoo FROM u)"""


def _constituents(spark: SparkSession, d: str) -> DataFrame:
    """Pages, each with a table of other columns before that of the constituents."""
    k = F.col("c_custkey")
    country = F.when(F.col("c_nationkey") % 3 == 0, "Germany").when(F.col("c_nationkey") % 3 == 1, "France").otherwise("Atlantis")
    ticker = F.when(k % 11 == 0, "not a ticker").when(k % 13 == 0, "").otherwise(F.concat(F.lit("T"), (k % 700).cast("string")))
    row = F.format_string("<tr><td> %s</td><td><b>%s</b></td><td>x</td><td>%s</td></tr>", ticker, "c_name", country)
    page = F.concat(F.lit("<table><tr><th>Other</th></tr><tr><td>1</td></tr></table><TABLE><tr><th>Ticker</th><th>Company</th><th>ICB Sector</th><th>Country</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</TABLE>"))
    pages = table(spark, d, "customer").groupBy((k % 50).alias("page")).agg(page.alias("html"))
    return readers.watchlist_rows(readers.html_table(pages, ["Ticker", "Company", "ICB Sector", "Country"]))


@query(f"WITH {CONSTITUENTS} SELECT ticker, company, country, yahoo FROM w")
def src_html_watchlist(spark, d):
    return _constituents(spark, d)


@query(f"""WITH {CONSTITUENTS}, l AS (SELECT country, yahoo, 1 AS nth, '  - ' || rpad(yahoo, greatest(12, 0), ' ') || '  # ' || company AS line FROM w
  UNION ALL SELECT country, min(yahoo), 0, '  # -- ' || country || ' --' FROM w GROUP BY country)
SELECT row_number() OVER (ORDER BY country, yahoo, nth) - 1 AS ord, line FROM l""")
def snk_watchlist_lines(spark, d):
    return readers.watchlist_lines(_constituents(spark, d))


def _bundle_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, clusters and heads of each year's bundle: a subject's clusters go by its number of articles."""
    t = triplets(spark, d).withColumn("date", F.concat(F.date_format("day", "yyyy"), F.lit("-12-31")))
    mix = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("event_type").alias("event"), "n")))
    mixes = t.groupBy("date", "sub", "event_type").agg(F.count("*").alias("n")).groupBy("date", "sub").agg(F.transform(mix, lambda x: F.struct(x["event"].alias("event"), x["n"].alias("n"))).alias("event_mix"))
    f = t.groupBy("date", F.col("sub").alias("name")).agg(F.count_distinct("url").alias("n_articles"), F.round(F.sum(F.col("sentiment").cast("decimal(18,4)")).cast("double") / F.count("sentiment"), 4).alias("s"), F.slice(F.array_sort(F.collect_set("obj")), 1, 3).alias("top_partners"))
    null = F.lit(None).cast("double")
    values = {"attention": F.col("n_articles").cast("double"), "sentiment": F.col("s"), "consensus": F.lit(1.0), "novelty": null, "materiality": F.lit(0.5)}
    rows = f.join(mixes.withColumnRenamed("sub", "name"), ["date", "name"]).select(
        "date", "name", F.lit('COMP "X"').alias("type"), (F.col("n_articles") % 3).cast("int").alias("cluster"), F.col("s").alias("pc1"), null.alias("pc2"), null.alias("pc3"),
        F.struct(*(values[c].alias(c) for c in values)).alias("factors"), "n_articles", "event_mix", "top_partners",
    )
    loading = F.array(F.struct(F.lit("sentiment").alias("factor"), F.round(F.avg("s"), 3).alias("loading")))
    clustered = rows.withColumn("s", F.col("factors.sentiment")).groupBy("date", "cluster").agg(F.count("*").cast("int").alias("size"), loading.alias("signature"), F.array_sort(F.collect_list("name")).alias("members"))
    head = rows.select("date").distinct().unionByName(spark.createDataFrame([("1900-12-31",)], "date string")).select(
        F.lit("c").alias("corpus"), "date", F.lit(None).cast("string").alias("generated_at"), F.lit(2).alias("min_articles"), F.array(F.lit("sentiment")).alias("kept_factors"), F.when(F.col("date") < "1950", "Only 0 entities.").alias("note"),
        F.array(F.substring("date", 1, 7)).alias("window_months"), F.array(F.lit(0.5)).alias("explained_variance"), F.array(F.array(F.lit(1.0), F.lit(-0.25))).alias("components"), F.lit(3).alias("k"), F.array(F.array(F.lit(0.0))).alias("centroids"),
    )
    return rows, clustered, head


@query(f"""{W}, t AS (SELECT strftime("day", '%Y') || '-12-31' AS date, sub AS name, url, obj, event_type, sentiment FROM triplets),
m AS (SELECT date, name, string_agg(event_type || ':' || n, ',' ORDER BY n DESC, event_type) AS mix FROM (SELECT date, name, event_type, count(*) AS n FROM t GROUP BY ALL) GROUP BY ALL),
f AS (SELECT date, name, count(DISTINCT url) AS n_articles, round(sum(sentiment::DECIMAL(18,4))::DOUBLE / count(sentiment), 4) AS s, array_to_string(list_sort(list(DISTINCT obj))[1:3], ',') AS partners FROM t GROUP BY ALL),
e AS (SELECT *, (n_articles % 3)::INT AS cluster, count(*) OVER (PARTITION BY date, n_articles % 3)::INT AS size FROM f JOIN m USING (date, name))
SELECT 'c' AS corpus, date, name, 'COMP "X"' AS type, cluster, size, s AS pc1, s AS sentiment, NULL::DOUBLE AS novelty, n_articles, mix, partners, 'sentiment' AS kept, NULL AS note, -0.25::DOUBLE AS component FROM e
UNION ALL SELECT 'c', '1900-12-31', NULL, NULL, -1, -1, NULL, NULL, NULL, -1, NULL, NULL, 'sentiment', 'Only 0 entities.', -0.25""")
def snk_bundle_documents(spark, d):
    """Bundles written as documents with pairs of a name and a number, and read again
    by VARIANT; one has no entities."""
    path = scratch(spark, "bundles")
    bundles.write_lines(bundles.document_lines(*_bundle_parts(spark, d)), path)
    docs = cut(bundles.read_lines(spark, path))
    kind = lambda k: docs.filter(F.col("kind") == k)
    mix = F.array_join(F.transform("event_mix", lambda x: F.concat(x["event"], F.lit(":"), x["n"].cast("string"))), ",").alias("mix")
    rows = bundles.entities(kind("entity")).select("date", "name", "type", "cluster", "pc1", F.col("factors.sentiment").alias("sentiment"), F.col("factors.novelty").alias("novelty"), "n_articles", mix, F.array_join("top_partners", ",").alias("partners"))
    sizes = bundles.clusters(kind("cluster")).select("date", "cluster", "size", F.explode("members").alias("name"))
    head = bundles.heads(kind("head")).select("corpus", "date", F.array_join("kept_factors", ",").alias("kept"), "note", F.col("components")[0][1].alias("component"))
    return head.join(rows.join(sizes, ["date", "cluster", "name"]), "date", "left").na.fill(-1, ["cluster", "size", "n_articles"])


TYPED = "CASE WHEN s_nationkey % 7 = 0 THEN NULL ELSE 'COMPANY' END"


@query(f"""{EDGES}, k AS (SELECT DISTINCT s_name AS node FROM supplier WHERE s_nationkey % 7 > 0)
SELECT "month" || '-15' AS date, sub, CASE WHEN k.node IS NULL THEN 'UNK' ELSE 'COMPANY' END AS sub_type, rel, rel_category, obj, 'UNK' AS obj_type, weight::DOUBLE AS w FROM edges LEFT JOIN k ON sub = node""")
def snk_training_rows(spark, d):
    """Months as rows of list literals of dicts, written as CSV and read as flat triplets."""
    e = edges(spark, d)
    types = table(spark, d, "supplier").filter("s_nationkey % 7 > 0").select(F.col("s_name").alias("node"), F.lit("COMPANY").alias("type")).distinct()
    path = scratch(spark, "training")
    writers.training_rows(graph.with_end_types(e, types).withColumnRenamed("weight", "w")).write.option("header", True).option("escape", '"').csv(path)
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return readers.weighted_triplets(rows.select("date", "output_triplets"))


@query(f"""WITH {ARTICLES_SQL} SELECT url, "month", date FROM articles""")
def snk_article_append(spark, d):
    """Articles appended twice, with those that are there already."""
    a = articles(spark, d).select("url", "month", "date")
    old = a.filter("date < '2020-07-01'")
    return writers.append_articles(writers.append_articles(old, a.unionByName(a)), a)


@query(f"""{W}, l AS (SELECT url, count(*) AS n FROM triplets WHERE "month" < '1995-06' GROUP BY url)
SELECT url, n FROM l UNION ALL SELECT DISTINCT url, 1 FROM triplets WHERE url NOT IN (SELECT url FROM l)""")
def snk_provenance(spark, d):
    """Triplets by url: what is there stays, urls without triplets are not added."""
    t = triplets(spark, d, False)
    lists = lambda rows: rows.groupBy("url").agg(F.collect_list(F.struct("sub", "rel", "obj")).alias("triplets"))
    fresh = lists(t).withColumn("triplets", F.slice("triplets", 1, 1))
    none = fresh.select(F.concat("url", F.lit("#none")).alias("url"), F.slice("triplets", 1, 0).alias("triplets"))
    return writers.append_provenance(lists(t.filter("month < '1995-06'")), fresh.unionByName(none)).select("url", F.size("triplets").cast("long").alias("n"))


@query(f"""{EDGES}, f AS (SELECT "month", sub, sum(weight)::BIGINT AS attention FROM edges GROUP BY ALL)
SELECT "month" || '-28' AS date, sub, 2 * attention AS attention FROM f WHERE "month" = (SELECT max("month") FROM f) UNION ALL SELECT "month" || '-28', NULL, count(*) FROM f GROUP BY "month\"""")
def snk_factor_bundles(spark, d):
    """Dated bundles, one of them replaced: the latest, and the dates that have entities."""
    path, schema = scratch(spark, "factors"), "sub string, attention long, date string"
    f = edges(spark, d).groupBy("month", "sub").agg(F.sum("weight").alias("attention"))
    f = f.select("sub", "attention", F.concat("month", F.lit("-28")).alias("date"))
    writers.write_bundle(f, path)
    writers.write_bundle(writers.read_bundle(spark, path, schema).withColumn("attention", 2 * F.col("attention")).transform(cut), path)
    index = writers.bundle_dates(spark, path, schema).select("date", F.lit(None).cast("string").alias("sub"), F.col("entities").alias("attention"))
    return writers.read_bundle(spark, path, schema).select("date", "sub", "attention").unionByName(index)


@query(f"""{W} SELECT url, sub, rel, obj, sub_type FROM triplets""")
def snk_canonical_csv(spark, d):
    """Triplets as list literals in a CSV without the revised column, and back."""
    t = triplets(spark, d, False)
    t = t.withColumn("rel", F.concat("rel", F.lit(" 'q', \\ \"\nx")))
    rows = t.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("sub", "sub_type", "rel", "rel_category", "obj", "obj_type"))).alias("triplets")).withColumn("revised", F.lit("x"))
    path = scratch(spark, "canonical")
    writers.write_canonical(rows, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    flat = readers.explode_triplets(readers.require(back, ["output_triplets"]).select("url", readers.parse_triplets(F.col("output_triplets")).alias("triplets")))
    return flat.filter("'revised' <> ''").select("url", "sub", F.replace("rel", F.lit(" 'q', \\ \"\nx"), F.lit("")).alias("rel"), "obj", "sub_type")


@query(f"{LEAD} SELECT period, rank, entity FROM lead")
def snk_predictions_json(spark, d):
    """A leaderboard as a JSON document for each period, and back."""
    from ..operators import predict

    path = scratch(spark, "predictions")
    writers.write_predictions(predict.leaderboard(important(spark, d), KINDS).select("period", "rank", "entity"), path)
    back = spark.read.schema("period string, entries array<struct<rank:long,entity:string>>").json(path)
    return back.select("period", F.explode("entries").alias("e")).select("period", "e.rank", "e.entity")


@query("""WITH v AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS rn, n_name FROM nation)
SELECT n_name AS id, CASE WHEN n_name = 'NATION_3' THEN 0.75 ELSE 0.25 END::DOUBLE AS mrr, (CASE WHEN n_name = 'NATION_3' THEN 0 WHEN n_name < 'NATION_3' AND rn < 4 THEN rn ELSE rn - 1 END)::BIGINT AS ord FROM v
UNION ALL SELECT 'new', 0.5::DOUBLE, count(*) FROM v""")
def snk_variants(spark, d):
    """An index of variants: one is added, and one replaced and moved to the front."""
    n = table(spark, d, "nation")
    index = n.select(F.col("n_name").alias("id"), F.lit(0.25).alias("mrr"), F.col("n_nationkey").cast("int").alias("ord"))
    new = spark.createDataFrame([("new", 0.5)], "id string, mrr double")
    front = spark.createDataFrame([("NATION_3", 0.75)], "id string, mrr double")
    out = readers.upsert_variants(readers.upsert_variants(index, new.withColumn("ord", F.lit(0))), front.withColumn("ord", F.lit(0)), front=True)
    return out.select("id", "mrr", F.col("ord").cast("long").alias("ord"))


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Sources with their kind, whether they are there, and their features."""
    s = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("lang")).alias("features"))
    n = F.substring("source", 4, 9).cast("int")
    return s.select(F.col("source").alias("id"), F.when(n % 5 == 0, "report").otherwise("live").alias("kind"), (n % 3 > 0).alias("available"), "features")


@query("""SELECT source AS id, array_to_string(list_sort(list(DISTINCT lang)), '|') || CASE WHEN source = 'src1' THEN '|predictions' ELSE '' END AS features FROM documents
WHERE source IS NOT NULL AND substring(source, 4)::INT % 3 > 0 AND substring(source, 4)::INT % 5 > 0 GROUP BY source""")
def ap_list_sources(spark, d):
    """Sources that are there and no report, one with a feature added twice."""
    c = _catalogue(spark, d)
    for _ in range(2):
        c = readers.add_feature(c, "src1", "predictions")
    return readers.listed_sources(c).select("id", F.array_join("features", "|").alias("features"))


@query(f"""WITH {ARTICLES_SQL} SELECT url, date, "month" FROM articles""")
def stream_month_store(spark, d):
    """Articles as micro-batches into the month store, run twice over doubled rows."""
    path, root = scratch(spark, "in"), scratch(spark, "store")
    a = articles(spark, d).select("url", "date")
    a.unionByName(a).repartition(4).write.parquet(path)
    store = ingest.MonthStore(spark, root)
    source = lambda: spark.readStream.schema("url string, date string").option("maxFilesPerTrigger", 2).parquet(path)
    for _ in range(2):
        ingest.run_available(source(), f"{root}/checkpoint", store.commit)
    return store.articles().join(store.ledger().select("h"), "h").select("url", "date", "month")


def _graph_batches(spark: SparkSession, d: str) -> list[DataFrame]:
    """A third of each month's triplets at a time, as enriched edges."""
    columns = ["month", "sub", "rel", "obj", "weight", "sentiment", "materiality_usd"]
    t = triplets(spark, d, few=True).withColumns({"k": F.col("seq") % 3, "event_type": F.lit(None)})
    rows = dealt(t.select("k", "month", "sub", "rel", "obj", "sentiment", "materiality_usd", "event_type"), table(spark, d, "lineitem").count(), "month", "sub")
    unused = {"url": F.lit(None), "seq": F.lit(None), "rel_category": F.lit(None)}
    # Written, all batches of one pass, as a batch's edges are read for its edges and nodes, and by each run.
    edges = cut(graph.enriched_edges(rows.withColumns(unused), "k").select("k", *columns))
    return [edges.filter(F.col("k") == k).select(*columns) for k in range(3)]


def running_graph(spark: SparkSession, d: str) -> ingest.GraphStore:
    store = ingest.GraphStore(spark, scratch(spark, "graph"))
    for k, e in enumerate(_graph_batches(spark, d)):
        nodes = cut(graph.ends(e, "month").select("month", "node").distinct()).withColumn("type", F.lit(f"batch{k}"))
        for _ in range(2):  # a batch that is run again changes nothing
            store.commit(e, nodes, k)
    return store


BATCH = """b{0} AS (SELECT "month", sub, rel, obj, count(*) AS weight, round(avg(sentiment), 4) AS sentiment, coalesce(sum(materiality_usd) FILTER (materiality_usd > 0), 0)::DOUBLE AS materiality_usd FROM triplets WHERE seq % 3 = {0} GROUP BY ALL)"""
MERGED = """{2} AS (SELECT "month", sub, rel, obj, (coalesce(a.weight, 0) + coalesce(b.weight, 0))::BIGINT AS weight,
  round(CASE WHEN a.weight IS NOT NULL AND b.weight IS NOT NULL THEN (a.sentiment + b.sentiment) / 2 ELSE coalesce(a.sentiment, b.sentiment) END, 4) AS sentiment, greatest(a.materiality_usd, b.materiality_usd) AS materiality_usd
  FROM {0} a FULL JOIN {1} b USING ("month", sub, rel, obj))"""


@query(f"""{W}, {BATCH.format(0)}, {BATCH.format(1)}, {BATCH.format(2)}, {MERGED.format("b0", "b1", "m1")}, {MERGED.format("m1", "b2", "m2")}
SELECT "month", sub, rel, obj, weight, round(sentiment, 3) AS sentiment, materiality_usd FROM m2""")
def stream_running_graph(spark, d):
    """A graph that three batches, each run twice, leave."""
    return running_graph(spark, d).edges().select("month", "sub", "rel", "obj", "weight", F.round("sentiment", 3).alias("sentiment"), "materiality_usd")


@query(f"""{W}, n AS (SELECT "month", seq % 3 AS k, sub AS node FROM triplets UNION ALL SELECT "month", seq % 3, obj FROM triplets)
SELECT "month", node, 'batch' || min(k) AS type FROM n GROUP BY ALL""")
def stream_running_nodes(spark, d):
    """Nodes of that graph: those there before stay as they are."""
    return running_graph(spark, d).nodes()


@query(f"""WITH {ARTICLES_SQL} SELECT "month", ticker, url, substring(text, 1, 600) AS summary FROM articles""")
def src_slim_articles(spark, d):
    """Articles by month with summaries of 600 characters."""
    return articles(spark, d).select("month", "ticker", "url", "summary")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'T0' WHEN doc_id % 4 = 2 THEN NULL ELSE 'T1' END AS title, 'a  b' || CASE WHEN length(text) > 30 THEN substring(text, 1, 30) || '…' ELSE text END AS cut FROM documents WHERE text IS NOT NULL""")
def txt_truncate(spark, d):
    t = table(spark, d, "documents").filter("text is not null")
    title = F.when(F.col("doc_id") % 4 == 0, "T0").when(F.col("doc_id") % 4 == 2, F.lit(None)).otherwise("T1")
    return t.select("doc_id", title.alias("title"), F.concat(F.lit("a  b"), text.truncate(F.col("text"), 30)).alias("cut"))
