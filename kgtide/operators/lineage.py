"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder below ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and the
    master is local, as in tests.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kgtide-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows of one task where rows are dealt by keys, and partitions up to which a task
#: writes them without holding its rows; beyond these, tasks may hold four times as many.
TASK_ROWS, DIRECT = 500_000, 200


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by its keys over so many tasks that what
    one holds does not grow with the table.

    For groupings by keys that seldom repeat: combining rows before the shuffle would
    hold a whole part of the input, and parts joined by their compressed size millions
    of rows.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(DIRECT, -(-rows // TASK_ROWS)), -(-rows // (4 * TASK_ROWS)))
    return df.repartition(tasks, *keys)


def broadcast_if_small(df: DataFrame, rows: int, size: int = 64 << 20) -> DataFrame:
    """Hints a broadcast for a written table of at most ``rows`` rows and ``size``
    bytes as JSON; beyond that the plain table, for a shuffled join."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= rows and found["size"] <= size else df
