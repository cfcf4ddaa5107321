"""The running graph as keyed state of a stream.

A key is a month and a bucket of its edges; its state lists these with the fold
of all batches so far: weights add, sentiments are averaged pairwise in the order
of batches, the larger materiality stands.  A state by bucket is read at once,
where one for each edge would be asked for edge by edge, and written as the edges
that a batch changes, compressed; a key's ``LISTED`` last are packed into one.  A timer lets
the state of a month go once the watermark is past the days in which it may still
change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lineage import dealt

KEY = ["month", "sub", "rel", "obj"]
EDGE = "month string, sub string, rel string, obj string, weight long, sentiment double, materiality_usd double, batch long"
COLUMNS = [x.split()[0] for x in EDGE.split(", ")]
#: Packed tables of a state, and their rows: an edge of a later table stands.
LISTED = 8
PACKED = pa.schema([*((c, pa.string()) for c in KEY[1:]), ("weight", pa.int64()), ("sentiment", pa.float64()), ("materiality_usd", pa.float64()), ("batch", pa.int64())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def month_end(month: str) -> int:
    """Milliseconds at which the month after ``month`` begins."""
    year, number = int(month[:4]), int(month[5:7])
    return int(datetime(year + number // 12, number % 12 + 1, 1, tzinfo=timezone.utc).timestamp() * 1000)


def fold(old: tuple | None, rows: list[tuple]) -> tuple:
    """(weight, sentiment, materiality_usd, batch) after further rows in the order of
    their batches; rows of batches that are in already change nothing."""
    for weight, sentiment, money, batch in sorted(rows, key=lambda r: r[3]):
        if old is None:
            old = (weight, sentiment, money, batch)
        elif batch > old[3]:
            mean = sentiment if old[1] is None else old[1] if sentiment is None else _round4((old[1] + sentiment) / 2)
            known = [x for x in (old[2], money) if x is not None]
            old = (old[0] + weight, mean, max(known) if known else None, batch)
    return old


def _round4(x: float) -> float:
    """Half up in decimal, as Spark rounds doubles."""
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def _none(x: Any) -> Any:
    return None if x is None or x != x else x


def packed(edges: dict[tuple, tuple]) -> bytes:
    """Edges (sub, rel, obj) with their folds as a compressed table; ends that repeat are
    written once."""
    rows = sorted(((*edge, *fold) for edge, fold in edges.items()), key=lambda r: tuple(x or "" for x in r[:3]))
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(PACKED)]
    table = pa.table([c.dictionary_encode() if i < 3 else c for i, c in enumerate(columns)], names=PACKED.names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(table: bytes) -> dict[tuple, tuple]:
    with pa.ipc.open_stream(table) as found:
        columns = [c.to_pylist() for c in found.read_all().columns]
    return dict(zip(zip(*columns[:3], strict=True), zip(*columns[3:], strict=True), strict=True))


class EdgeFold(StatefulProcessor):
    """Gives each edge that a batch changes, as it is afterwards."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("packed", "edges binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple, list[tuple]] = {}
        for part in rows:
            for sub, rel, obj, w, s, m, b in part[["sub", "rel", "obj", "weight", "sentiment", "materiality_usd", "batch"]].itertuples(index=False):
                fresh.setdefault((sub, rel, obj), []).append((int(w), _none(s), _none(m), int(b)))
        tables, edges = [bytes(x[0]) for x in self.state.get()], {}
        for table in tables:
            edges.update(unpacked(table))
        if not edges:
            self.handle.registerTimer(month_end(key[0]) + self.days * 86_400_000)
        changed = {edge: fold(edges.get(edge), found) for edge, found in fresh.items()}
        if len(tables) < LISTED:
            self.state.appendValue((packed(changed),))
        else:
            self.state.put([(packed(edges | changed),)])
        yield pd.DataFrame([(key[0], *edge, *state) for edge, state in changed.items()], columns=COLUMNS)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=COLUMNS)

    def close(self) -> None:
        pass


def folded(edges: DataFrame, days: int = 120, buckets: int = 16) -> DataFrame:
    """A stream of edges (``EDGE`` and ``ts``, when they came) as the edges that each
    micro-batch changes.  The watermark follows ``ts`` by a day: edges that come
    later than that fall away.  A month's edges are dealt over ``buckets`` keys."""
    timed = edges.withWatermark("ts", "1 day").withColumn("bucket", F.pmod(F.xxhash64("sub", "rel", "obj"), F.lit(buckets)))
    return timed.groupBy("month", "bucket").transformWithStateInPandas(statefulProcessor=EdgeFold(days), outputStructType=EDGE, outputMode="Update", timeMode="EventTime")


class StateGraph:
    """The running graph that the state of a stream writes: a folder for each
    micro-batch with the edges it changed, of which the last counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _put(self, fail: Callable[[int], None] | None) -> Callable[[DataFrame, int], None]:
        def put(rows: DataFrame, batch: int) -> None:
            rows.withColumn("_run", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_run").parquet(f"{self.root}/edges")
            if fail:
                fail(batch)

        return put

    def run(self, source: DataFrame, days: int = 120, buckets: int = 16, fail: Callable[[int], None] | None = None) -> None:
        """All that the source has; ``fail`` is called after each batch's write, for tests."""
        known = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        try:
            query = folded(source, days, buckets).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{self.root}/checkpoint").foreachBatch(self._put(fail)).start()
            query.awaitTermination()
        finally:
            if known is None:
                self.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
            else:
                self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", known)

    def edges(self) -> DataFrame:
        rows = self.spark.read.schema(f"{EDGE}, _run long").parquet(f"{self.root}/edges")
        last = dealt(rows, rows.count(), *KEY).groupBy(*KEY).agg(F.max_by(F.struct("weight", "sentiment", "materiality_usd"), F.struct("batch", "_run")).alias("x"))
        return last.select(*KEY, "x.*")
