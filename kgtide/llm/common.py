"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words in most contracts.
WS = " \t\n\x0b\f\r"
WS_SPLIT = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Named by ``spark.checkpoint.dir``; where that is unset (tests on a local
    master) a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    own = "file://" + tempfile.mkdtemp(prefix="kgtide-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Paths that this process has handed out and not removed.
_made: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/kgtide/{tag}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def made() -> list[str]:
    """Paths handed out and not removed, in turn."""
    return list(_made)


def sweep(spark: SparkSession, keep: list[str] | None = None) -> list[str]:
    """Removes what ``scratch`` has handed out but for ``keep``, and returns what is left.

    Results read these files: sweep once they are written elsewhere.
    """
    for path in [x for x in _made if x not in (keep or [])]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.remove(path)
    return list(_made)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Cuts the lineage: what stands below is computed once, and survives lost
    executors as files of the shared folder do.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, size: int = 64 << 20) -> DataFrame:
    """Hints a broadcast for a written table of at most ``rows`` rows and ``size``
    bytes as JSON; beyond that the plain table, for a shuffled join."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and found["size"] <= size else df


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ws_words(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text."""
    trimmed = F.btrim(c, F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_SPLIT))
