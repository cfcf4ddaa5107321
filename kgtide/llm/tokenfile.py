"""Token ids in ORC files.

Documents are encoded where they are read, dealt by ranges of their id and
written in order as ORC: the ids of a document are one list, stored as
run-length encoded integers in stripes with row indexes and a Bloom filter on
the id.  A reader takes stripes in parallel and skips those whose indexes
exclude an id.  The ranges come from a sample of the documents, so that no text
is encoded twice; the text's hash and, for repeated rows, the row's place cut
the ids that many rows share.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, scratch
from .tokens import coder, default_vocabulary


#: Bytes of text of a file, about; rows of the sample at least, and one in so many of all.
FILE_BYTES, SAMPLE, ONE_IN = 128 << 20, 20_000, 10_000

Bound = tuple[bool, int, int, int]


def range_bounds(rows: DataFrame) -> list[Bound]:
    """Keys (has an id, id, tie, salt) that cut ``rows`` into ranges of alike size.

    There are at least as many ranges as cores.  The driver holds the keys of a
    sample: ``SAMPLE`` rows, or one in ``ONE_IN`` if these are more.
    """
    n = rows.count()
    share = min(1.0, max(SAMPLE, n / ONE_IN) / max(n, 1))
    some = rows if share == 1 else rows.sample(share, seed=11)
    found = some.select("doc_id", "tie", "salt", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes")).toArrow().to_pydict()
    keys = sorted(zip([d is not None for d in found["doc_id"]], [d or 0 for d in found["doc_id"]], found["tie"], found["salt"], strict=True))
    n_files = max(2 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(found["bytes"]) / share / FILE_BYTES))
    return [keys[i * len(keys) // n_files] for i in range(1, n_files)] if keys else []


def range_of(ids: pa.Array, ties: np.ndarray, salts: np.ndarray, bounds: list[Bound], firsts: np.ndarray) -> np.ndarray:
    """The range of each row; ``firsts`` are the bounds' ids, null as 0 in front."""
    n_null = sum(not b[0] for b in bounds)
    has, doc = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    lo, hi = n_null + np.searchsorted(firsts[n_null:], doc, "left"), n_null + np.searchsorted(firsts[n_null:], doc, "right")
    lo, hi = np.where(has, lo, 0), np.where(has, hi, n_null)
    for i in np.flatnonzero(lo != hi).tolist():  # the id of a bound
        lo[i] = bisect_left(bounds, (bool(has[i]), int(doc[i]), int(ties[i]), int(salts[i])), lo[i], hi[i])
    return lo


def write_token_files(docs: DataFrame, path: str, end_id: int = 1, vocabulary: str | None = None) -> None:
    """Writes doc_id, tie, ids as ORC below ``path``, ascending by (doc_id, tie).

    ``tie`` is a hash of the text and orders rows of one id.  A null text is
    empty and holds the end id alone; null ids come first.  Repeated rows may
    fall into several files.
    """
    vocab = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"), F.col("text").cast("string").alias("text"))
    bounds = range_bounds(rows)
    firsts = np.array([b[1] for b in bounds], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(vocab)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [code.packed(t.as_py()) + end for t in part.column(3)]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int64)
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                dealt = range_of(part.column(0), part.column(1).to_numpy(), part.column(2).to_numpy(), bounds, firsts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(dealt, pa.int32())], names=["doc_id", "tie", "ids", "range"])

    coded = rows.mapInArrow(encode, "doc_id long, tie long, ids array<int>, range int")
    dealt = coded.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("doc_id", "tie").select("doc_id", "tie", "ids")
    dealt.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("compression", "zstd").orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The documents of ``path``, or those with the given ids, which prune by the
    files' indexes and Bloom filters."""
    rows = spark.read.schema("doc_id long, tie long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.filter(F.col("doc_id").isin(doc_ids))


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, tie, n_tokens, ids_crc32 and file of every stored document."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends = ids.offsets.to_numpy()
            flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64()), batch.column(3)], names=["doc_id", "tie", "n_tokens", "ids_crc32", "file"])

    return rows.select("doc_id", "tie", "ids", F.input_file_name().alias("file")).mapInArrow(crc, "doc_id long, tie long, n_tokens long, ids_crc32 long, file string")


def op6_token_files(docs: DataFrame, end_id: int = 1) -> DataFrame:
    """Writes all ``docs``, reads the files back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all rows before, by id (null first) and then by
    text hash; repeated rows follow each other; very long texts are encoded whole,
    and other columns are not looked at.  A null text holds the end id
    alone; an empty table gives an empty result.  Files hold ranges of ids, so the starts
    are sums within a file plus the sum of the files before it.
    """
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_token_files(docs, path, end_id)
    rows = cut(digest(read_token_files(spark, path)), "digest")
    order = ["doc_id", "tie"]
    files = rows.groupBy("file").agg(F.min(F.struct("doc_id", "tie")).alias("first"), F.max(F.struct("doc_id", "tie")).alias("last"), F.sum("n_tokens").alias("n"))
    before = files.select("file", (F.sum("n").over(Window.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # a row for each file
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy(*order, "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    out = rows.withColumn("inside", inside).join(before, "file")
    return out.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
