"""One daily run, from planned fetches to articles and the running graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.lineage import cut
from ..sources import feeds, readers
from . import ingest

Extract = Callable[[DataFrame], DataFrame]
#: Fetches of one task, whose bodies are one file.
EACH = 64


class DailyRun:
    """A stream over a plan of fetches.

    Each batch of the plan is fetched once and kept as it came (``raw``), parsed,
    freed of stale and known articles, appended to the articles, handed to
    ``extract``, and merged into the graph.  All writes are folders of the batch, so
    a batch that a crash cut off is done again and doubles nothing.
    """

    def __init__(self, spark: SparkSession, plans: str, root: str, extract: Extract, source: str = "feeds"):
        self.spark, self.plans, self.root, self.extract, self.source = spark, plans, root, extract, source
        self.articles = ingest.MonthStore(spark, f"{root}/news", "title", "source", "text")
        self.graph = ingest.GraphStore(spark, f"{root}/graph")

    def raw(self, batch: int | None = None) -> DataFrame:
        """What was fetched, errors included; ``run`` numbers the stream's batches."""
        path = f"{self.root}/raw"
        rows = self.spark.read.schema(f"{feeds.SCHEMA}, run long").parquet(path)
        return rows if batch is None else rows.filter(F.col("run") == batch)

    def _batch(self, rows: DataFrame, batch: int, today: Column, days: int, news: bool) -> None:
        rows.withColumn("run", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{self.root}/raw")
        items = readers.rss_items(self.raw(batch).filter("error is null").select("item", "body"), today, xml="body", news=news)
        fresh = cut(ingest.first_wins(ingest.fresh_only(items, today, days), "item", "ord").withColumn("date", F.col("date").cast("string")))  # parsed once
        self.articles.commit(fresh.select("url", "date", "title", "source", "text"), batch)
        triplets = self.extract(self.articles.articles(batch))
        edges = graph.enriched_edges(graph.clean(triplets, drop_loops=True)).select("month", "sub", "rel", "obj", "weight", "sentiment", "materiality_usd")
        nodes = graph.node_types(triplets, "first", "month").select("month", "node", "type")
        self.graph.commit(edges, nodes, batch)

    def run(self, today: Column, days: int = 120, news: bool = True) -> None:
        """All batches of the plan that are new."""
        source = self.spark.readStream.format(self.source).option("each", EACH).load(self.plans)
        ingest.run_available(source, f"{self.root}/checkpoint", lambda rows, batch: self._batch(rows, batch, today, days, news))
