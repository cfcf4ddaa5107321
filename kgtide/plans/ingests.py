"""Queries on ingest: fetched feeds, the daily run, keyed state and the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import scratch
from ..sources import feeds, readers
from ..sources.adapter import ARTICLES_SQL, TRIPLETS_SQL, articles, table
from ..streaming import daily, ingest, late, ledger, state
from .files import BATCH, FEED, MERGED, _feeds, _graph_batches
from .registry import query

TODAY = "2021-07-01"
SERVER_TASKS = 200


def _server(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """A folder of feed documents, and the fetches of them; every seventh is not there."""
    root = scratch(spark, "server")
    # A file for each feed: small rows, which would all be written by one task.
    _feeds(spark, d).repartition(SERVER_TASKS).write.partitionBy("feed").text(root)
    base = root if "://" in root else "file://" + root.removeprefix("file:")
    feed = F.floor(F.col("doc_id") / 40).cast("string")
    plan = table(spark, d, "documents").filter("doc_id is not null").select(feed.alias("item")).distinct()
    kept = F.when(F.col("item").cast("long") % 7 == 3, "gone").otherwise("feed")
    return base, plan.select(F.lit("google_news").alias("source"), "item", F.concat(F.lit(f"{base}/"), kept, F.lit("="), "item").alias("url"))


ITEMS = f"""i AS (SELECT doc_id, {FEED} AS feed, (row_number() OVER (PARTITION BY {FEED} ORDER BY doc_id) - 1)::INT AS ord, lang FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, feed, ord, CASE WHEN doc_id % 3 = 0 THEN 'Doc <' || doc_id || '>' ELSE 'Doc & ' || doc_id END AS title, 'http://x/' || doc_id AS url,
  CASE WHEN doc_id % 2 = 0 THEN 'google_news:' || lang ELSE 'google_news' END AS source, CASE WHEN doc_id % 4 = 0 THEN DATE '{TODAY}' ELSE DATE '2021-03-01' + (doc_id % 200)::INT + 1 END AS date
  FROM i WHERE ord < 25 AND feed % 9 <> 4 AND feed % 7 <> 3)"""


@query(f"""WITH {ITEMS} SELECT feed, ord, url, source, NULL AS error FROM f UNION ALL SELECT DISTINCT feed, -1, NULL, NULL, 'FileNotFoundError' FROM i WHERE feed % 7 = 3
UNION ALL SELECT DISTINCT feed, -1, NULL, NULL, 'broken' FROM i WHERE feed % 9 = 4 AND feed % 7 <> 3""")
def src_fetched_feeds(spark, d):
    """Feeds fetched by a plan: items, fetches that failed, and feeds that are broken."""
    name = feeds.register(spark)
    _, plan = _server(spark, d)
    plans = scratch(spark, "plan")
    feeds.append_plan(plan, plans, 0)
    raw = spark.read.format(name).option("tries", 1).option("each", 20).load(plans)
    got = raw.select(F.col("item").cast("long").alias("feed"), F.col("body"), F.split("error", ":")[0].alias("error"))
    items = readers.rss_items(got.filter("error is null").drop("error"), F.lit(TODAY).cast("date"), xml="body", news=True).select("feed", "ord", "url", "source")
    failed = got.filter("error is not null").select("feed", F.lit(-1).alias("ord"), "error")
    broken = readers.broken_feeds(got.filter("error is null"), xml="body").select("feed", F.lit(-1).alias("ord"), F.lit("broken").alias("error"))
    return items.unionByName(failed, allowMissingColumns=True).unionByName(broken, allowMissingColumns=True)


def _planned_run(spark: SparkSession, d: str) -> daily.DailyRun:
    """Two batches of a plan, of which the second fetches some feeds again, as two runs and an idle one."""
    name = feeds.register(spark)
    _, plan = _server(spark, d)
    plans = scratch(spark, "plan")

    def extract(news: DataFrame) -> DataFrame:
        """A triplet for each article, in the place of a model."""
        kind = lambda x: F.lit(x)
        return news.select(
            "month", "url", F.lit(0).cast("long").alias("seq"), F.col("source").alias("sub"), kind("COMPANY").alias("sub_type"), kind("Reports").alias("rel"), kind("GMM").alias("rel_category"),
            F.concat(F.lit("Topic "), F.length("title").cast("string")).alias("obj"), kind("CONCEPT").alias("obj_type"), (F.length("url") / 20).alias("sentiment"), F.length("url").cast("double").alias("materiality_usd"), kind("other").alias("event_type"),
        )

    run = daily.DailyRun(spark, plans, scratch(spark, "daily"), extract, name)
    number = F.col("item").cast("long")
    feeds.append_plan(plan.filter(number % 2 == 0), plans, 0)
    run.run(F.lit(TODAY).cast("date"))
    feeds.append_plan(plan.filter((number % 2 == 1) | (number % 4 == 0)), plans, 1)
    for _ in range(2):
        run.run(F.lit(TODAY).cast("date"))
    return run


FRESH = f"""{ITEMS}, a AS (SELECT *, strftime(date, '%Y-%m') AS "month", feed % 2 AS k FROM f WHERE date >= DATE '{TODAY}' - 120)"""


@query(f"""WITH {FRESH} SELECT url, "month", date::VARCHAR AS date, title, source, k AS batch FROM a""")
def stream_daily_articles(spark, d):
    """Articles that daily runs append: fetched, fresh, each once."""
    return _planned_run(spark, d).articles.articles().select("url", "month", "date", "title", "source", "batch")


@query(f"""WITH {FRESH}, b AS (SELECT "month", source AS sub, 'Topic ' || length(title) AS obj, k, count(*) AS weight, round(avg(length(url) / 20), 4) AS s, sum(length(url))::DOUBLE AS m FROM a GROUP BY ALL)
SELECT "month", sub, 'Reports' AS rel, obj, sum(weight)::BIGINT AS weight, round(CASE WHEN count(*) = 2 THEN round((min(s) + max(s)) / 2, 4) ELSE min(s) END, 3) AS sentiment, max(m) AS materiality_usd FROM b GROUP BY ALL""")
def stream_daily_graph(spark, d):
    """The graph that those runs leave."""
    return _planned_run(spark, d).graph.edges().withColumn("sentiment", F.round("sentiment", 3))


@query(f"""WITH {TRIPLETS_SQL}, {BATCH.format(0)}, {BATCH.format(1)}, {BATCH.format(2)}, {MERGED.format("b0", "b1", "m1")}, {MERGED.format("m1", "b2", "m2")}
SELECT "month", sub, rel, obj, weight, round(sentiment, 3) AS sentiment, materiality_usd FROM m2""")
def stream_keyed_graph(spark, d):
    """The running graph as keyed state of a stream over three batches, in three runs."""
    path, graph = scratch(spark, "edges"), state.StateGraph(spark, scratch(spark, "state"))
    for k, e in enumerate(_graph_batches(spark, d)):
        rows = e.withColumns({"batch": F.lit(k).cast("long"), "ts": F.to_timestamp(F.lit(f"2000-01-{k + 1:02}"))})
        rows.write.mode("append").parquet(path)
        graph.run(spark.readStream.schema(f"{state.EDGE}, ts timestamp").parquet(path), days=36_500)
    return graph.edges().withColumn("sentiment", F.round("sentiment", 3))


@query(f"""WITH {ARTICLES_SQL}, k AS (SELECT substring(sha256(url), 1, 16) AS h, CASE WHEN date < '2020-09-01' THEN 0 WHEN date < '2021-05-01' THEN 1 ELSE 2 END AS batch FROM articles)
SELECT h, min(batch)::BIGINT AS batch FROM k GROUP BY h""")
def ingest_bucketed_ledger(spark, d):
    """The ledger after three batches, each with the rows of those before, and a compaction between."""
    root = scratch(spark, "ledger")
    book = ledger.Ledger(spark, root)
    keys = articles(spark, d).select(ingest.text.url_hash(F.col("url")).alias("h"), F.when(F.col("date") < "2020-09-01", 0).when(F.col("date") < "2021-05-01", 1).otherwise(2).alias("k"))
    for batch in range(3):
        book.add(book.unseen(keys.filter(F.col("k") <= batch).select("h"), batch), batch)
        if batch == 1:
            book.compact(1)
    return book.rows().select("h", "batch")


def _files(spark: SparkSession, path: str, parts: list[DataFrame]) -> None:
    """Each part as files of its own, in turn."""
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(path)


@query("""WITH e AS (SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS k FROM events)
SELECT event_id, k FROM e JOIN events USING (event_id) WHERE ts >= TIMESTAMP '2024-01-09' OR event_id % 5 > 0""")
def stream_late_rows(spark, d):
    """Events in three files, some twice, a fifth of the first days' rows as late as
    the third: what the watermark lets through, each once."""
    e = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    k = F.when(F.col("ts") < "2024-01-11", 0).when(F.col("ts") < "2024-01-21", 1).otherwise(2)
    e = e.withColumn("k", k)
    path, root = scratch(spark, "late"), scratch(spark, "once")
    again = F.explode(F.sequence(F.lit(0), F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)))
    lost = (F.col("ts") < "2024-01-09") & (F.col("event_id") % 5 == 0)
    _files(spark, path, [e.filter((F.col("k") == n) & ~lost | (lost if n == 2 else F.lit(False))).withColumn("_again", again).drop("_again") for n in range(3)])
    source = spark.readStream.schema("event_id long, ts timestamp, k int").option("maxFilesPerTrigger", 1).parquet(path)
    put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
    ingest.run_available(late.once(source, "event_id", "ts", "1 day"), f"{root}/checkpoint", put)
    return spark.read.schema("event_id long, ts timestamp, k int").option("recursiveFileLookup", True).parquet(f"{root}/rows").select("event_id", "k")
