"""The driver's tables as the engine's model: articles, triplets, embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import broadcast_if_small

#: Suppliers that are broadcast at most, where they are counted.
FEW = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triplets(spark: SparkSession, sf_dir: str, events: bool = True, few: bool = False) -> DataFrame:
    """Edge occurrences: an order is an article, a line item one of its triplets.

    Without ``events`` there is no event type, and orders are not joined for it.
    ``seq`` is the place in the article and carries all order-sensitive rules.
    With ``few``, suppliers are counted, and broadcast if they are small.
    """
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    supplier = broadcast_if_small(supplier, FEW) if few else supplier
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    flag = F.concat("l_returnflag", "l_linestatus")
    rel = F.when(flag == "AF", "Acquires").when(flag == "AO", "Supplies").when(flag == "NF", "Reports").when(flag == "NO", "Competes With").when(flag == "RF", "Sues").otherwise("Impacts")
    category = F.when(F.col("l_returnflag") == "A", "SSI").when(F.col("l_returnflag") == "N", "GMM").otherwise("GFMK")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    rows = line.withColumn("seq", seq)
    if events:
        rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.concat(F.lit("order://"), F.col("l_orderkey").cast("string")).alias("url"), "seq",
        F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.to_date("l_shipdate").alias("day"),
        F.col("s_name").alias("sub"), F.when(F.col("s_nationkey") % 7 == 0, "UNK").when(F.col("l_tax") > 0.06, "STOCK_TICKER").otherwise("COMPANY").alias("sub_type"),
        rel.alias("rel"), category.alias("rel_category"),
        F.col("p_brand").alias("obj"), F.when(F.col("l_tax") < 0.02, "UNK").otherwise("PRODUCT").alias("obj_type"),
        F.round((F.col("l_discount") - 0.05) * 20, 2).alias("sentiment"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice").cast("decimal(18,2)")).alias("materiality_usd"),
        *([F.col("o_orderpriority").alias("event_type")] if events else []), F.col("s_nationkey").alias("nation"),
    )


TRIPLETS_SQL = """
triplets AS (
  SELECT 'order://' || l_orderkey AS url, seq, strftime(l_shipdate, '%Y-%m') AS "month", l_shipdate::DATE AS "day",
    s_name AS sub, CASE WHEN s_nationkey % 7 = 0 THEN 'UNK' WHEN l_tax > 0.06 THEN 'STOCK_TICKER' ELSE 'COMPANY' END AS sub_type,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'Acquires' WHEN 'AO' THEN 'Supplies' WHEN 'NF' THEN 'Reports' WHEN 'NO' THEN 'Competes With' WHEN 'RF' THEN 'Sues' ELSE 'Impacts' END AS rel,
    CASE l_returnflag WHEN 'A' THEN 'SSI' WHEN 'N' THEN 'GMM' ELSE 'GFMK' END AS rel_category,
    p_brand AS obj, CASE WHEN l_tax < 0.02 THEN 'UNK' ELSE 'PRODUCT' END AS obj_type,
    round((l_discount - 0.05) * 20, 2) AS sentiment, CASE WHEN l_tax > 0 THEN l_extendedprice::DECIMAL(18,2) END AS materiality_usd,
    o_orderpriority AS event_type, s_nationkey AS nation
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq FROM lineitem)
  JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 730).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.substring("text", 1, 60).alias("title"),
        F.substring("text", 1, 600).alias("summary"), "text", F.upper("source").alias("ticker"), date.cast("string").alias("date"), F.date_format(date, "yyyy-MM").alias("month"),
    )


ARTICLES_SQL = """
articles AS (
  SELECT 'doc://' || doc_id AS url, substring(text, 1, 60) AS title, substring(text, 1, 600) AS summary, text, upper(source) AS ticker,
    (DATE '2020-01-01' + (doc_id % 730)::INT)::VARCHAR AS date, strftime(DATE '2020-01-01' + (doc_id % 730)::INT, '%Y-%m') AS "month"
  FROM documents)"""


def node_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("label") % 4 == 0, "COMPANY").when(F.col("label") % 4 == 1, "STOCKTICKER").when(F.col("label") % 4 == 2, "SECTOR").otherwise("CONCEPT")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("node_"), F.col("vec_id").cast("string")).alias("entity"), F.concat(F.lit("2024-0"), (F.col("vec_id") % 2 + 1).cast("string")).alias("period"),
        kind.alias("entity_type"), F.concat(F.lit("k"), F.when(F.col("label") < 3, F.floor(F.col("vec_id") / 4)).otherwise(F.col("vec_id") + 1_000_000).cast("string")).alias("alias"),
        F.col("embedding").cast("array<double>").alias("e"),
    )


EMBEDDINGS_SQL = """
nodes AS (
  SELECT 'node_' || vec_id AS entity, '2024-0' || (vec_id % 2 + 1) AS period,
    CASE label % 4 WHEN 0 THEN 'COMPANY' WHEN 1 THEN 'STOCKTICKER' WHEN 2 THEN 'SECTOR' ELSE 'CONCEPT' END AS entity_type,
    'k' || CASE WHEN label < 3 THEN vec_id // 4 ELSE vec_id + 1000000 END AS alias, embedding::DOUBLE[] AS e
  FROM embeddings)"""


def dirty_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity names with their frequency, decorated in the ways that feeds do."""
    k = F.col("p_partkey") % 8
    name = (
        F.when(k == 0, F.concat("p_name", F.lit(" Inc."))).when(k == 1, F.upper("p_name")).when(k == 2, F.concat(F.lit("The "), F.col("p_name"))).when(k == 3, F.concat("p_name", F.lit(" Corp. Cl A")))
        .when(k == 4, F.concat("p_name", F.lit(" & Co"))).when(k == 5, F.concat((F.col("p_partkey") % 90).cast("string"), F.lit(" million USD"))).when(k == 6, F.concat(F.lit("Q"), (F.col("p_partkey") % 4 + 1).cast("string"), F.lit(" results"))).otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select(name.alias("name")).groupBy("name").agg(F.count("*").alias("freq"))


NAMES_SQL = """
names AS (
  SELECT name, count(*) AS freq FROM (
    SELECT CASE p_partkey % 8 WHEN 0 THEN p_name || ' Inc.' WHEN 1 THEN upper(p_name) WHEN 2 THEN 'The ' || p_name WHEN 3 THEN p_name || ' Corp. Cl A' WHEN 4 THEN p_name || ' & Co'
      WHEN 5 THEN (p_partkey % 90) || ' million USD' WHEN 6 THEN 'Q' || (p_partkey % 4 + 1) || ' results' ELSE p_name END AS name FROM part) GROUP BY name)"""
