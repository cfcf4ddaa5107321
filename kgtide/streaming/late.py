"""Late and repeated rows by watermark, beside the absolute age of ``fresh_only``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, key: str = "url", time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once.  The watermark follows the newest row by ``late``.  Rows fall away
    that are older than it was before the last micro-batch; what is known of a key
    is forgotten once it is ``late`` past the key's first row."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def with_triplets(articles: DataFrame, triplets: DataFrame, wait: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Streams of articles (url, ts, …) and triplets (url, ts, …) as articles with the
    triplets that come within ``wait`` of them; an article for which none came is
    given without once the watermarks are past its wait."""
    a = articles.withWatermark("ts", late).alias("a")
    t = triplets.withWatermark("ts", late).alias("t")
    near = (F.col("a.url") == F.col("t.url")) & (F.col("t.ts") >= F.col("a.ts")) & (F.col("t.ts") <= F.col("a.ts") + F.expr(f"INTERVAL {wait}"))
    columns = [F.col(f"a.{c}") for c in articles.columns] + [F.col(f"t.{c}") for c in triplets.columns if c not in ("url", "ts")]
    return a.join(t, near, "leftOuter").select(*columns)
