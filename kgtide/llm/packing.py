"""Best-fit packing by minimum bin slack.

Lengths are whole numbers up to the capacity, so the state of the packing is a
histogram with at most ``capacity`` entries, whatever the size of the corpus.
On that histogram the driver repeats: put the longest length left into a bin,
find by a bitset subset-sum over the lengths left (with their counts) the
fullest filling, and use this filling as often as the counts allow.  Each such
step uses up a length, so there are at most about ``capacity`` steps.  The
pieces of a length are then numbered, in salted groups, and numbers look up the
bin and the place in it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import coder, default_vocabulary

#: Least pieces of one length that are numbered in one task.  Groups grow as the
#: square root of a length's pieces, so that the list of its groups stays short too.
GROUP = 200

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Token pieces of every row: doc_id, piece, start, length, ids_crc32.

    A null text is empty and yields the end id alone.  Null and repeated ids
    are kept, each row on its own.
    """
    path = vocabulary or default_vocabulary()
    end = end_id.to_bytes(4, "little")
    width = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = code.packed(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    for col, v in zip(cols, (doc, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The fullest multiset of the counted lengths that fits into ``room``, by
    subset sums on a bitset; long lengths are tried first."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fillings as (bins, length -> copies in each bin), minimum slack first fixed
    by the longest length left."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        rest = fullest({k: v for k, v in left.items() if v}, capacity - longest)
        left[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in rest.items())
        out.append((bins, rest))
        for k, n in rest.items():
            left[k] -= bins * n
            if not left[k]:
                del left[k]
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to capacity.

    All rows are placed; bins have no gaps.  ``pieces`` is read twice: hand in
    a written table.  An empty table gives an empty result.  Repeated rows are
    placed one by one; a column that tells them apart lets tasks share them.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    key, first, copies, base, offset, bins_so_far, used = [], [], [], [], [], 0, dict.fromkeys(histogram, 0)
    for bins, filling in patterns(histogram, capacity):
        at = 0
        for length, n in sorted(filling.items(), reverse=True):
            for col, v in zip((key, first, copies, base, offset), (length, used[length], n, bins_so_far, at), strict=True):
                col.append(v)
            used[length] += bins * n
            at += n * length
        bins_so_far += bins
    table = np.array([key, first, copies, base, offset], dtype=np.int64).reshape(5, -1)
    table = table[:, np.lexsort((table[1], table[0]))]
    held = spark.sparkContext.broadcast(table)  # at most a few entries for each of capacity lengths and steps

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lens, firsts, copies, base, offset = held.value
        want_len, want = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        shift = np.int64(1) << 44
        at = np.searchsorted(lens * shift + firsts, want_len * shift + want, side="right") - 1
        inside = want - firsts[at]
        return pd.DataFrame({"sequence_id": base[at] + inside // copies[at], "offset": offset[at] + (inside % copies[at]) * want_len})

    # Names that a caller's columns don't have.
    salts = spark.createDataFrame([(k, -(-n // max(GROUP, math.isqrt(n)))) for k, n in histogram.items()], "length long, __salts long")
    ids = [c for c in pieces.columns if c != "length"]
    salted = pieces.join(F.broadcast(salts), "length").withColumn("__salt", F.pmod(F.xxhash64(*ids), F.col("__salts")))
    before = (
        salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
        .withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "__salt", F.coalesce("__before", F.lit(0)).alias("__before"))
    )
    local = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*ids)) - 1
    ranked = salted.withColumn("__local", local).join(before, ["length", "__salt"])
    placed = ranked.withColumn("__place", place("length", F.col("__before") + F.col("__local")))
    return placed.select(*pieces.columns, "__place.sequence_id", "__place.offset")


def op1_packing(docs: DataFrame, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, text); see ``token_pieces`` and ``pack``.

    Very long texts are encoded and cut whole; other columns are not looked at; an
    empty table gives an empty result."""
    pieces = cut(token_pieces(docs, capacity, end_id).withColumn("_place", F.monotonically_increasing_id()), "pieces")
    return pack(pieces, capacity).drop("_place")
