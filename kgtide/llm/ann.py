"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are projected to a few dimensions by seeded Gaussian (2-stable) vectors:
the squared projected distance over the squared distance then follows a
chi-square law with as many degrees of freedom.  A kd-tree over projections of a
bounded sample cuts space into cells, and further trees, over samples of their
own, the cells that hold too many rows; every vector is indexed in its cell, and
each task holds a kd-tree of one.  A query takes projected neighbours in
ascending distance and verifies them on the original vectors, until for the
next projected distance the chance that a nearer vector is still to come, by the
chi-square test against the k-th distance so far, is small enough.  It first
searches its own cell, and then the cells that the same test does not exclude.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

#: Projected dimensions (even), the test's confidence, rows of a leaf and of a cell, queries of a task.
DIMS, CONFIDENCE, LEAF, CELL, QUERIES = 12, 0.97, 64, 25_000, 2_000
#: Cells of the first tree at most and the rows that it is cut from; rows for each cell of a further tree.
TOP, SAMPLE, EACH = 1024, 32_768, 32
#: Vectors of one length up to which they are compared with each other, unless it is among so many of the most frequent lengths.
FEW, SIZES = 2_000, 4


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, dims: int) -> float:
    lo, hi = 0.0, 1e3
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


def projection(size: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, dims))


def split_points(points: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """Heap-ordered (dimension, value) splits of a kd-tree with ``cells`` leaves,
    a power of two."""
    out: list[tuple[int, float]] = []
    level = [points]
    while len(out) < cells - 1:
        below = []
        for part in level:
            dim = int(part.var(axis=0).argmax()) if len(part) else 0
            value = float(np.median(part[:, dim])) if len(part) else 0.0
            out.append((dim, value))
            below += [part[part[:, dim] <= value], part[part[:, dim] > value]]
        level = below
    return out


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    dims, values = np.array([d for d, _ in splits], np.int64), np.array([v for _, v in splits])
    for _ in range((len(splits) + 1).bit_length() - 1):
        at = 2 * at + 1 + (points[np.arange(len(points)), dims[at]] > values[at])
    return at - len(splits)


def cell_boxes(splits: list[tuple[int, float]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = [np.full(dims, -np.inf)], [np.full(dims, np.inf)]
    for at, (d, v) in enumerate(splits):
        a, b = hi[at].copy(), lo[at].copy()
        a[d], b[d] = min(a[d], v), max(b[d], v)
        lo += [lo[at], b]
        hi += [a, hi[at]]
    return np.array(lo[len(splits) :]), np.array(hi[len(splits) :])


def box_distance(point: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(np.maximum(lo - point, point - hi), 0.0)
    return np.einsum("ij,ij->i", gap, gap)


class Cells:
    """Cells of a first tree, each cut further by a tree of its own or not.

    ``top`` and the values of ``below`` are heap-ordered splits: 16 bytes for a
    cell, so the whole stays small beside the ``CELL`` vectors of each.
    """

    def __init__(self, top: list[tuple[int, float]], below: dict[int, list[tuple[int, float]]], dims: int):
        self.top, self.below, self.dims = top, below, dims
        self.first = np.concatenate([[0], np.cumsum([len(below.get(c, ())) + 1 for c in range(len(top) + 1)])])
        self.lo, self.hi = cell_boxes(top, dims)
        self.boxes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, points: np.ndarray) -> np.ndarray:
        at = cell_of(points, self.top)
        out = self.first[at]
        for c in np.unique(at).tolist():
            if c in self.below:
                own = at == c
                out[own] += cell_of(points[own], self.below[c])
        return out

    def near(self, point: np.ndarray, gap: float) -> np.ndarray:
        """Cells within the squared distance ``gap`` of a point."""
        found = []
        for c in np.flatnonzero(box_distance(point, self.lo, self.hi) <= gap).tolist():
            if c in self.below:
                if c not in self.boxes:
                    self.boxes[c] = cell_boxes(self.below[c], self.dims)
                found.append(self.first[c] + np.flatnonzero(box_distance(point, *self.boxes[c]) <= gap))
            else:
                found.append(self.first[c : c + 1])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Tree:
    """A kd-tree whose leaves hold runs of the reordered rows."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order, runs, todo = [], [], [np.arange(len(points))]
        at = 0
        while todo:
            part = todo.pop()
            if len(part) > leaf:
                own = points[part]
                dim = int(own.var(axis=0).argmax())
                half = np.argpartition(own[:, dim], len(part) // 2)
                todo += [part[half[: len(part) // 2]], part[half[len(part) // 2 :]]]
            elif len(part):
                order.append(part)
                runs.append((at, at + len(part)))
                at += len(part)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.points = points[self.order]
        self.runs = runs
        self.lo = np.array([self.points[a:b].min(0) for a, b in runs])
        self.hi = np.array([self.points[a:b].max(0) for a, b in runs])


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, point: np.ndarray, query: np.ndarray, own: int, k: int, bound: float, limit: float) -> list[tuple[float, int, int]]:
    """The k nearest found as (distance, id, copies), ties to the smaller id.

    ``vectors``, ``ids`` and ``copies`` are in the tree's order; ``bound`` is a
    squared k-th distance known already.  Of the query's own row, the one with
    its id and vector, one copy is left out.  Leaves come in ascending projected
    distance; the search ends when the next one's is ``limit`` times the k-th so
    far, squared.
    """
    gaps = box_distance(point, tree.lo, tree.hi)
    best = np.zeros((0, 2))
    order, at, step = np.argsort(gaps, kind="stable"), 0, 2
    while at < len(order) and gaps[order[at]] <= limit * bound:
        rows = np.concatenate([np.arange(*tree.runs[x]) for x in order[at : at + step]])
        at, step = at + step, min(2 * step, 64)
        off = tree.points[rows] - point
        rows = rows[np.einsum("ij,ij->i", off, off) <= limit * bound]
        diff = vectors[rows] - query
        d2 = np.einsum("ij,ij->i", diff, diff)
        near = (d2 <= bound) & ((ids[rows] != own) | (d2 > 0) | (copies[rows] > 1))
        found = np.stack([d2[near], rows[near]], axis=1)
        best = np.concatenate([best, found])
        best = best[np.lexsort((ids[best[:, 1].astype(np.int64)], best[:, 0]))][:k]
        if len(best) == k:
            bound = min(bound, best[-1, 0])
    return [(math.sqrt(d), int(ids[r]), int(copies[r]) - int(d == 0 and ids[r] == own)) for d, r in ((d, int(r)) for d, r in best)]


def usable(rows: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part.

    Not null ids; embeddings that are not null, not all zero, and without null
    or non-finite components.
    """
    inf = float("inf")
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("embedding", lambda x: x != 0)
    found = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return found.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(ok)


def matrix(col: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    whole = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def fit_cells(index: DataFrame, total: int, base: np.ndarray) -> Cells:
    """Cells of about ``CELL`` of the ``total`` rows of ``index`` (vec_id, embedding).

    The first tree is cut from about ``SAMPLE`` rows.  Where it would need more than
    ``TOP`` cells, the rows of each are counted, and a further tree for each is
    cut by a task, from a sample of ``EACH`` rows for each of its cells.
    """
    size, dims = base.shape
    points = ", ".join(f"p{i} double" for i in range(dims))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (matrix(batch.column(0), size) @ base).T], names=[f"p{i}" for i in range(dims)])

    cells = 1 << max(0, math.ceil(math.log2(max(1, total / CELL))))
    # By chance of the hash, so each task gives its share and none merges the others'.
    chance = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 40)) / float(1 << 40)
    some = index.filter(chance < SAMPLE / max(1, total)).select("embedding").mapInArrow(project, points).toArrow()
    top = split_points(np.stack([c.to_numpy() for c in some.columns], axis=1), min(cells, TOP))
    if cells <= TOP:
        return Cells(top, {}, dims)
    held = Cells(top, {}, dims)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = matrix(batch.column(1), size) @ base
                yield pa.RecordBatch.from_arrays([pa.array(held.of(found)), batch.column(0), *(pa.array(x) for x in found.T)], names=["cell", "chance", *(f"p{i}" for i in range(dims))])

    dealt = index.select(F.rand(7).alias("chance"), "embedding").mapInArrow(deal, f"cell long, chance double, {points}")
    counts = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most TOP rows
    wanted = {c: 1 << math.ceil(math.log2(n / CELL)) for c, n in counts.items() if n > CELL}
    if not wanted:
        return held
    share = index.sparkSession.createDataFrame([(c, w, EACH * w / counts[c]) for c, w in wanted.items()], "cell long, wanted long, share double")

    def split(group: pa.Table) -> pa.Table:
        own = np.stack([group.column(f"p{i}").to_numpy() for i in range(dims)], axis=1)
        found = split_points(own, group.column("wanted")[0].as_py())
        return pa.table({"cell": group.column("cell")[: 1], "at": [[d for d, _ in found]], "value": [[v for _, v in found]]}, schema=pa.schema([("cell", pa.int64()), ("at", pa.list_(pa.int64())), ("value", pa.list_(pa.float64()))]))

    chosen = dealt.join(F.broadcast(share), "cell").filter("chance < share").drop("chance", "share")
    below = chosen.groupBy("cell").applyInArrow(split, "cell long, at array<long>, value array<double>").collect()  # a number for each cell
    return Cells(top, {r["cell"]: list(zip(r["at"], r["value"], strict=True)) for r in below}, dims)


def _nearest(ready: DataFrame, size: int, total: int, k: int, every: int, dims: int, confidence: float, seed: int) -> DataFrame:
    """query_id, qid, repeats, vec_id, score and copies among vectors of one size."""
    ready = ready.filter(F.size("embedding") == size)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    index = cut(ready.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n"), "index")
    base = projection(size, dims, seed)
    cells, limit = fit_cells(index, total, base), chi_square_quantile(confidence, dims)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells.of(matrix(batch.column("embedding"), size) @ base)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], names=[*batch.schema.names, "cell"])

    placed = "vec_id long, embedding array<double>, copies long, cell long"
    dealt = cut(index.mapInArrow(deal, placed), "dealt")
    queries = ready.filter(F.pmod("vec_id", F.lit(every)) == 0).mapInArrow(deal, placed)
    queries = cut(queries.select(F.monotonically_increasing_id().alias("qid"), F.col("vec_id").alias("query_id"), F.col("copies").alias("repeats"), F.col("embedding").alias("query"), "cell"), "queries")
    found_schema = pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("copies", pa.int64())])

    def look(asked: pa.Table, data: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and data.num_rows:
            vectors = matrix(data.column("embedding"), size)
            tree = Tree(vectors @ base)
            vectors, ids, copies = vectors[tree.order], data.column("vec_id").to_numpy()[tree.order], data.column("copies").to_numpy()[tree.order]
            points = matrix(asked.column("query"), size)
            for qid, own, bound, q in zip(*(asked.column(c).to_pylist() for c in ("qid", "query_id", "bound")), points, strict=True):
                out += [(qid, x, d, n) for d, x, n in search(tree, vectors, ids, copies, q @ base, q, own, k, bound, limit)]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 4, found_schema.types, strict=True)], schema=found_schema)

    def searched(asked: DataFrame) -> DataFrame:
        """Cells with many queries are copied for blocks of these, others are held once."""
        load = cut(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("blocks")), "load")
        small = broadcast_if_small(load, 1_000_000)
        q = asked.join(small, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks"))).select("qid", "query_id", "query", "bound", "cell", "block")
        d = dealt.join(small, "cell").select("vec_id", "embedding", "copies", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        return cut(q.groupBy("cell", "block").cogroup(d.groupBy("cell", "block")).applyInArrow(look, "qid long, vec_id long, score double, copies long"), "found")

    first = searched(queries.withColumn("bound", F.lit(float("inf"))))
    bounds = first.groupBy("qid").agg(F.count("*").alias("n"), (F.max("score") * F.max("score")).alias("kth"))
    asked = queries.join(bounds, "qid", "left").withColumn("bound", F.when(F.col("n") == k, F.col("kth") * (1 + 1e-12)).otherwise(F.lit(float("inf"))))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows_, cells_ = [], []
            for i, (point, home, bound) in enumerate(zip(matrix(batch.column("query"), size) @ base, batch.column("cell").to_pylist(), batch.column("bound").to_pylist(), strict=True)):
                near = cells.near(point, limit * bound)
                near = near[near != home]
                rows_ += [i] * len(near)
                cells_ += near.tolist()
            taken = batch.take(pa.array(rows_, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("qid", "query_id", "query", "bound")), pa.array(cells_, pa.int64())], names=["qid", "query_id", "query", "bound", "cell"])

    more = asked.select("qid", "query_id", "query", "bound", "cell").mapInArrow(others, "qid long, query_id long, query array<double>, bound double, cell long")
    second = searched(cut(more, "more"))
    return first.unionByName(second).join(queries.select("qid", "query_id", "repeats"), "qid")


def _of_rare_sizes(ready: DataFrame, common: list[int], k: int, every: int) -> DataFrame:
    """What ``_nearest`` gives, for vectors of all other sizes: at most ``FEW`` of
    each, so a task compares those of a size with each other."""
    given = pa.schema([("query_id", pa.int64()), ("qid", pa.int64()), ("repeats", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("copies", pa.int64()), ("size", pa.int32())])

    def compare(group: pa.Table) -> pa.Table:
        size = group.column("size")[0].as_py()
        ids, copies, vectors = group.column("vec_id").to_numpy(), group.column("copies").to_numpy(), matrix(group.column("embedding"), size)
        out = []
        for i in np.flatnonzero(ids % every == 0).tolist():
            d = np.sqrt(np.square(vectors - vectors[i]).sum(1))
            left = copies - (np.arange(len(ids)) == i)
            for j in [j for j in np.lexsort((ids, d)).tolist() if left[j] > 0][:k]:
                out.append((int(ids[i]), i, int(copies[i]), int(ids[j]), float(d[j]), int(left[j]), size))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, given.types, strict=True)], schema=given)

    rest = ready.withColumn("size", F.size("embedding")).filter(~F.col("size").isin(common))
    return rest.groupBy("size").applyInArrow(compare, "query_id long, qid long, repeats long, vec_id long, score double, copies long, size int")


def nearest(rows: DataFrame, k: int = 10, every: int = 100, dims: int = DIMS, confidence: float = CONFIDENCE, seed: int = 11) -> DataFrame:
    """The k nearest found of each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all
    rows but the query's own.  Null ids, and vectors that are null, zero or hold
    null or non-finite components, take no part.  A repeated row is a candidate,
    and a query, as often as it stands there; rows of one id with different
    vectors are candidates of each other.  Vectors of different lengths are never
    near; the ``SIZES`` most frequent lengths, and others of over ``FEW`` vectors, have
    an index, vectors of rare lengths are compared with each other.  An empty table
    gives an empty result; columns besides vec_id and embedding are not looked at,
    and very long vectors are taken whole.

    Of equal vectors only the k + 1 smallest ids can be among a query's nearest,
    so others are left out of the index without loss.
    """
    spark = rows.sparkSession
    ready = cut(usable(rows).groupBy("vec_id", "embedding").agg(F.count("*").alias("copies")), "vectors")
    sizes = cut(ready.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")), "sizes")
    large = {r["size"]: r["n"] for some in (sizes.filter(F.col("n") > FEW), sizes.orderBy(F.desc("n"), "size").limit(SIZES)) for r in some.collect()}  # one in FEW rows at most, and a few
    if not large:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, [_nearest(ready, size, n, k, every, dims, confidence, seed).withColumn("size", F.lit(size)) for size, n in sorted(large.items())])
    if sizes.count() > len(large):
        found = found.unionByName(_of_rare_sizes(ready, sorted(large), k, every))
    each = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    rank = F.row_number().over(Window.partitionBy("size", "qid").orderBy("score", "vec_id"))
    ranked = each.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.withColumn("_repeat", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(rows: DataFrame) -> DataFrame:
    """The 10 nearest found of each query; see ``nearest``."""
    return nearest(rows)
