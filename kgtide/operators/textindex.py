"""A trigram index for searches of substrings.

``add`` writes a segment: its articles, dealt over parts of so many rows, and a
row for each trigram and 64 articles in turn, with a bit for each that has it, sorted
by trigram in Parquet's delta encodings, so that a look-up reads the pages of its
trigrams.  Bits are set before rows are shuffled, which is a fraction of the places.  Of each term the rarest
trigrams are looked up; articles that have all of them are candidates, and only
their parts are read.  What is read is searched as the plain table is, so results
are those of a scan.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import readers
from .graph import positions
from .lineage import broadcast_if_small, cut

#: Rows of a part; trigrams of a term that are looked up; candidates up to which their list is broadcast.
PART_ROWS, LOOKED_UP, LISTED = 4096, 3, 1_000_000
#: Articles of one row of a trigram's, as bits of a long.
BITS, POSTINGS = 64, "gram string, _word long, docs long"


def trigrams(c: Column) -> Column:
    """The trigrams of a text in lower case, each once."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("(?s)(?=(...))"), 1))


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, *fields: str):
        """``fields`` are the texts that are searched."""
        self.spark, self.root, self.fields = spark, root, fields

    def add(self, articles: DataFrame, segment: int, *order: str, part_rows: int = PART_ROWS) -> None:
        """Adds articles in the order given; a segment that is there is replaced."""
        at = f"{self.root}/segment={segment}"
        rows = positions(articles, *order).withColumn("_part", F.floor(F.col("pos") / part_rows)).withColumnRenamed("pos", "_doc")
        rows.write.mode("overwrite").partitionBy("_part").parquet(f"{at}/articles")
        rows = self.spark.read.schema(rows.schema).parquet(f"{at}/articles")
        every = F.explode(F.array_distinct(F.flatten(F.array(*(trigrams(F.col(f)) for f in self.fields))))).alias("gram")
        bit = F.expr(f"shiftleft(1L, cast(_doc % {BITS} AS int))").alias("bit")
        marked = rows.select(every, F.floor(F.col("_doc") / BITS).alias("_word"), bit).groupBy("gram", "_word").agg(F.bit_or("bit").alias("docs"))
        postings = marked.repartitionByRange("gram", "_word").sortWithinPartitions("gram", "_word")
        postings.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").parquet(f"{at}/postings")
        held = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings")
        held.groupBy("gram").agg(F.sum(F.bit_count("docs")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{at}/grams")
        self.spark.range(1).select(F.lit(part_rows).cast("long").alias("part_rows"), F.lit(rows.schema.json()).alias("schema")).write.mode("overwrite").parquet(f"{at}/about")

    def segments(self) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
        return sorted(f"{self.root}/{x}" for x in found if x.startswith("segment=") and readers.exists(self.spark, f"{self.root}/{x}/about/_SUCCESS"))

    def candidates(self, at: str, terms: list[str]) -> DataFrame | None:
        """_doc of a segment's articles that may hold a term; None for all of them,
        where a term is too short to look up."""
        if any(len(t) < 3 for t in terms):
            return None
        wanted = [sorted({t.lower()[i : i + 3] for i in range(len(t.lower()) - 2)}) for t in terms]
        every = sorted({g for some in wanted for g in some})
        known = {r["gram"]: r["n"] for r in self.spark.read.schema("gram string, n long").parquet(f"{at}/grams").filter(F.col("gram").isin(every)).collect()}  # those of the query
        rarest = [sorted(some, key=lambda g: (known[g], g))[:LOOKED_UP] for some in wanted if all(g in known for g in some)]
        rows = F.explode(F.array(*(F.struct(F.lit(k).alias("term"), F.lit(len(some)).alias("size"), F.lit(g).alias("gram")) for k, some in enumerate(rarest) for g in some))).alias("x") if rarest else None
        held = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings")
        if rows is None:
            return held.filter("false").select(F.col("_word").alias("_doc"))
        held = held.filter(F.col("gram").isin(sorted({g for some in rarest for g in some})))
        looked_up = F.broadcast(self.spark.range(1).select(rows).select("x.*"))  # a few for each term
        hits = held.join(looked_up, "gram").groupBy("term", "size", "_word").agg(F.count("*").alias("n"), F.bit_and("docs").alias("docs")).filter("n = size and docs <> 0")
        some = hits.groupBy("_word").agg(F.bit_or("docs").alias("docs"))
        at_bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("docs", i) == 1))
        return some.select("_word", at_bit.alias("_bit")).select((F.col("_word") * BITS + F.col("_bit")).alias("_doc"))

    def matching(self, terms: list[str]) -> DataFrame:
        """The articles of all segments that may hold one of the terms; without terms
        all articles."""
        out = None
        for at in self.segments():
            about = self.spark.read.schema("part_rows long, schema string").parquet(f"{at}/about").first()
            rows = self.spark.read.schema(StructType.fromJson(json.loads(about["schema"]))).parquet(f"{at}/articles")
            found = self.candidates(at, terms) if terms else None
            if found is not None:
                found = cut(found)
                parts = [r["_part"] for r in found.select(F.floor(F.col("_doc") / about["part_rows"]).alias("_part")).distinct().collect()]  # as many as parts of the table
                rows = rows.filter(F.col("_part").isin(parts)).join(broadcast_if_small(found, LISTED), "_doc", "left_semi")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            raise FileNotFoundError(f"no segment in {self.root}")
        return out.drop("_doc", "_part")
