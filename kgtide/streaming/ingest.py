"""Daily ingest as micro-batches: stale filter, ledger, month upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators.graph import pair_fold, positions
from ..operators.lineage import dealt
from ..sources import readers
from .ledger import Ledger


def fresh_only(a: DataFrame, today: Column, days: int = 120, date: str = "date") -> DataFrame:
    return a.filter(F.col(date).cast("date") >= F.date_sub(today, days))


def unseen(a: DataFrame, ledger: DataFrame) -> DataFrame:
    """Articles not in the ledger, once each."""
    return a.withColumn("h", text.url_hash(F.col("url"))).dropDuplicates(["h"]).join(ledger.select("h"), "h", "left_anti")


def first_wins(a: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("url").orderBy(*order)
    return a.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def take_slice(names: DataFrame, n: int, m: int, order: str) -> DataFrame:
    """The n-th (from 1) of m contiguous slices, each as large as the rounded-up share."""
    total = names.agg(F.ceil(F.count("*") / m).alias("_size"))  # one row
    placed = positions(names, order).crossJoin(F.broadcast(total))
    return placed.filter(F.floor(F.col("pos") / F.col("_size")) == n - 1).drop("pos", "_size")


def staleness(a: DataFrame, today: Column, days: int = 3) -> DataFrame:
    return a.agg(F.max("date").alias("latest")).withColumn("stale", F.datediff(today, F.col("latest").cast("date")) > days)


def run_available(source: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Everything that is there as micro-batches, then stops; restarts go on after
    the last committed batch."""
    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(batch).start()
    query.awaitTermination()


class MonthStore:
    """Articles as a table of batches, and the ledger of their urls: each batch is a
    folder that a repeated run replaces, so a crash between the writes loses and
    doubles nothing."""

    def __init__(self, spark: SparkSession, root: str, *extra: str):
        """``extra``: further columns of articles, texts all."""
        self.spark, self.root, self.extra = spark, root, extra
        self.seen = Ledger(spark, f"{root}/ledger")

    def ledger(self, before: int | None = None) -> DataFrame:
        return self.seen.rows(before).select("h", "batch")

    def articles(self, batch: int | None = None) -> DataFrame:
        """All articles, or those that a batch brought."""
        schema = ", ".join(["url string, date string, h string, month string", *(f"{c} string" for c in self.extra), "batch long"])
        if not readers.exists(self.spark, f"{self.root}/articles"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/articles")
        return rows if batch is None else rows.filter(F.col("batch") == batch)

    def count(self) -> int:
        return self.ledger().count()

    def commit(self, rows: DataFrame, batch: int) -> None:
        """Appends the articles (url, date and extra columns) whose url is new."""
        keyed = rows.withColumn("h", text.url_hash(F.col("url")))
        new = self.seen.unseen(keyed, batch).withColumns({"month": F.substring("date", 1, 7), "batch": F.lit(batch).cast("long")})
        # The ledger takes what is written, so both hold the same articles.
        new.select("url", "date", "h", "month", *self.extra, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/articles")
        self.seen.add(self.articles(batch).select("h"), batch)


class GraphStore:
    """A running graph by month, as what each batch brings.

    A batch folder is replaced when its batch is run again, so a crash doubles
    nothing.  Readers merge the batches in their order: a commit writes its own rows
    alone, however large the months that they touch.
    """

    EDGES = "month string, sub string, rel string, obj string, weight long, sentiment double, materiality_usd double, batch long"
    NODES = "month string, node string, type string, batch long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str, schema: str, before: int | None) -> DataFrame:
        if not readers.exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return rows if before is None else rows.filter(F.col("batch") < before)

    def edges(self, before: int | None = None) -> DataFrame:
        rows = self._read("edge_batches", self.EDGES, before)
        return pair_fold(dealt(rows, rows.count(), "month", "sub", "rel", "obj"), "batch", "month")

    def nodes(self, before: int | None = None) -> DataFrame:
        """Nodes as the first batch that has them types them."""
        rows = self._read("node_batches", self.NODES, before)
        return rows.groupBy("month", "node").agg(F.min_by("type", "batch").alias("type"))

    def commit(self, edges: DataFrame, nodes: DataFrame, batch: int) -> None:
        """Adds a batch's edges, each once, and nodes to the months that they touch."""
        for name, rows in {"edge": edges, "node": nodes}.items():
            rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.root}/{name}_batches")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling or sliding counts by type; on a stream, late rows up to the bound."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("v")).select(F.col("w.start").alias("start"), "event_type", "n", F.col("v").cast("double").alias("v"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
