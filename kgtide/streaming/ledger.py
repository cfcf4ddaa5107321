"""The ledger of seen keys, in buckets of their hash.

Keys of a batch lie in ``new/batch=K/bucket=BB``; compaction puts all up to a
batch into ``whole/upto=K/bucket=BB``.  A look-up names the buckets of its keys, so
the others are not read; in a bucket keys are sorted, so row groups fall away too.
A batch that is run again replaces its folder, and a compaction counts only once
it is written in full, so a crash loses and doubles nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "h string, batch long, bucket string"
#: Hexadecimal digits of a key's hash that name its bucket.
DIGITS = 2


class Ledger:
    def __init__(self, spark: SparkSession, root: str, digits: int = DIGITS):
        self.spark, self.root, self.digits = spark, root, digits

    def _names(self, path: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []

    def compacted(self) -> int:
        """The last batch of the last compaction that is whole; -1 for none."""
        found = [x for x in self._names(f"{self.root}/whole") if x.startswith("upto=")]
        return max((int(x[5:]) for x in found if "_SUCCESS" in self._names(f"{self.root}/whole/{x}")), default=-1)

    def rows(self, before: int | None = None) -> DataFrame:
        """h, batch, bucket of all keys, or of those of earlier batches."""
        upto = self.compacted()
        read = self.spark.read.schema(SCHEMA)
        out = self.spark.createDataFrame([], SCHEMA)
        if upto >= 0:
            path = f"{self.root}/whole/upto={upto}"
            out = out.unionByName(read.parquet(path))
        fresh = [f"{self.root}/new/{x}" for x in self._names(f"{self.root}/new") if x.startswith("batch=") and int(x[6:]) > upto]
        if fresh:
            out = out.unionByName(read.option("basePath", f"{self.root}/new").parquet(*fresh))
        return out if before is None else out.filter(F.col("batch") < before)

    def bucket(self) -> F.Column:
        return F.substring("h", 1, self.digits)

    def among(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of the buckets that ``keys`` (h) fall into."""
        named = [r["bucket"] for r in keys.select(self.bucket().alias("bucket")).distinct().collect()]  # at most 16 ** digits
        return self.rows(before).filter(F.col("bucket").isin(named))

    def unseen(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows (with h) whose key is not there, each key once."""
        once = rows.dropDuplicates(["h"])
        return once.join(self.among(once, before).select("h"), "h", "left_anti")

    def add(self, keys: DataFrame, batch: int) -> None:
        """Keys (h) of a batch; those of an earlier run of it go."""
        placed = keys.select("h", self.bucket().alias("bucket"))
        placed.repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/new/batch={batch}")

    def compact(self, upto: int) -> None:
        """One run of files for all batches up to ``upto``; what it replaces is removed afterwards."""
        if upto <= self.compacted():
            return
        rows = self.rows(upto + 1)
        path = f"{self.root}/whole/upto={upto}"
        rows.repartition("bucket").sortWithinPartitions("bucket", "h").write.mode("overwrite").partitionBy("bucket").parquet(path)
        self._drop([f"{self.root}/whole/{x}" for x in self._names(f"{self.root}/whole") if x.startswith("upto=") and int(x[5:]) < upto])
        self._drop([f"{self.root}/new/{x}" for x in self._names(f"{self.root}/new") if x.startswith("batch=") and int(x[6:]) <= upto])

    def _drop(self, paths: list[str]) -> None:
        for path in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
