"""PCA and k-means over factors, layouts, PageRank, encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import canon, repulsion
from .factors import FACTORS, standardise
from .graph import positions
from .lineage import cut, scratch


def pca_kmeans(f: DataFrame, restarts: int = 10, seed: int = 42) -> dict:
    """Components, clusters and their signatures of standardised factors.

    Fewer than four entities, or no factor with variance, gives an empty bundle
    with a note.  The sign of a component makes its largest loading positive.
    """
    z, kept = standardise(f, list(FACTORS))
    z = cut(z)  # ten fits and the components read it
    n = z.count()
    if n < 4 or not kept:
        return {"entities": None, "kept": kept, "note": "too few entities" if n < 4 else "no factor varies", "k": 0}
    rows = VectorAssembler(inputCols=[f"z_{c}" for c in kept], outputCol="features").transform(z)
    model = PCA(k=min(3, len(kept)), inputCol="features", outputCol="pcs").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(loadings.shape[1])])
    k = min(5, max(2, n // 4))
    best = min((KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(rows) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    out = best.transform(model.transform(rows))
    pcs = [(vector_to_array("pcs")[i] * float(s)).alias(f"pc{i + 1}") for i, s in enumerate(signs)]
    centres = best.clusterCenters()
    signatures = [[(kept[i], float(c[i])) for i in np.argsort(-np.abs(c), kind="stable")[:3]] for c in centres]
    return {"entities": out.select("sub", "attention", "cluster", *pcs), "kept": kept, "k": k, "explained": model.explainedVariance.toArray().tolist(), "components": (loadings * signs).T.tolist(), "centroids": [c.tolist() for c in centres], "signatures": signatures, "note": None}


#: Nodes from which on a push is summed by cells, and partitions over which months are
#: dealt, so many that two seldom meet in one.
MANY, MONTH_PARTS = 4096, 1024


def _pushed(pos: np.ndarray, first: int, last: int, k: float) -> np.ndarray:
    """How all nodes push those from ``first`` up to ``last``.  Rows are taken by a few,
    so that what is worked on stays in the processor's cache."""
    x, y = np.ascontiguousarray(pos[:, 0]), np.ascontiguousarray(pos[:, 1])
    rows = max(1, min(16, 65_536 // max(len(x), 1)))
    dx, dy, pull, square = np.empty((4, rows, len(x)))
    out = np.empty((last - first, 2))
    for at in range(first, last, rows):
        m = min(rows, last - at)
        u, v, w, z = dx[:m], dy[:m], pull[:m], square[:m]
        np.subtract(x[at : at + m, None], x, out=u)
        np.subtract(y[at : at + m, None], y, out=v)
        np.multiply(u, u, out=w)
        np.multiply(v, v, out=z)
        np.add(w, z, out=w)
        np.maximum(w, 1e-4, out=w)
        np.divide(k * k, w, out=w)
        out[at - first : at - first + m, 0] = np.einsum("ij,ij->i", u, w)
        out[at - first : at - first + m, 1] = np.einsum("ij,ij->i", v, w)
    return out


def _step(pos: np.ndarray, first: int, last: int, subs: np.ndarray, objs: np.ndarray, t: float) -> np.ndarray:
    """Nodes from ``first`` up to ``last`` after a step of at most ``t``; ``subs`` and ``objs``
    are the edges (a, b) in order whose subject or object is among them."""
    k = 1 / np.sqrt(len(pos))
    push = (_pushed if len(pos) < MANY else repulsion.pushed)(pos, first, last, k)
    for pairs, own, sign in ((subs, 0, -1), (objs, 1, 1)):
        pull = pos[pairs[:, 0]] - pos[pairs[:, 1]]
        np.add.at(push, pairs[:, own] - first, sign * pull * (np.sqrt((pull**2).sum(-1)) / k)[:, None])
    size = np.maximum(np.sqrt((push**2).sum(-1)), 0.01)
    return pos[first:last] + push / size[:, None] * np.minimum(size, t)[:, None]


def _scaled(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, scale: float) -> np.ndarray:
    return np.round((pos - lo) / np.maximum(hi - lo, 1e-9) * scale, 2)


def spring_layout(e: DataFrame, iterations: int = 120, scale: float = 1000.0, seed: int = 7) -> DataFrame:
    """Fruchterman-Reingold coordinates by month within a square canvas.  A task places
    a month; see ``spread_layout`` for a large one.  From ``MANY`` nodes on, pushes are
    summed by cells: as exact as by pairs, though steps make much of what is rounded."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["sub"]) | set(pdf["obj"]))
        at = {x: i for i, x in enumerate(names)}
        n = len(names)
        pos = np.random.default_rng(seed).random((n, 2))
        edges = np.stack([pdf["sub"].map(at).to_numpy(), pdf["obj"].map(at).to_numpy()], axis=1)
        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]  # sums don't depend on the order of rows
        t = 0.1
        for _ in range(iterations):
            pos = _step(pos, 0, n, edges, edges, t)
            t -= 0.1 / (iterations + 1)
        pos = _scaled(pos, pos.min(0), pos.max(0), scale)
        return pd.DataFrame({"month": pdf["month"].iloc[0], "node": names, "x": pos[:, 0], "y": pos[:, 1]})

    return e.select("month", "sub", "obj").repartition(MONTH_PARTS, "month").groupBy("month").applyInPandas(place, "month string, node string, x double, y double")


def spread_layout(e: DataFrame, iterations: int = 120, scale: float = 1000.0, seed: int = 7, least: int = 4096) -> DataFrame:
    """node, x, y: what ``spring_layout`` gives for the edges (sub, obj) of one graph.

    From ``least`` nodes on, each step is a job in which a task moves a block of nodes;
    it holds all coordinates, their cells' series (16 bytes a node, and up to 88) and its
    own nodes' edges.
    """
    spark = e.sparkSession
    names = cut(dictionary(e.select(F.explode(F.array("sub", "obj")).alias("node")))).select("node", (F.col("id") - 1).alias("id"))
    n = names.count()
    if n < least:
        return spring_layout(e.select(F.lit("").alias("month"), "sub", "obj"), iterations, scale, seed).select("node", "x", "y")
    blocks = min(-(-n // 512), max(1, 2 * spark.sparkContext.defaultParallelism))
    size = -(-n // blocks)
    blocks = -(-n // size)
    ends = e.join(names.select(F.col("node").alias("sub"), F.col("id").alias("a")), "sub").join(names.select(F.col("node").alias("obj"), F.col("id").alias("b")), "obj")
    side = lambda i, c: F.struct(F.floor(F.col(c) / size).cast("int").alias("block"), F.lit(i).alias("side"))
    edges = cut(ends.select("a", "b", F.explode(F.array(side(0, "a"), side(1, "b"))).alias("s")).select("s.block", "s.side", "a", "b"))
    schema = "block int, x array<double>, y array<double>"

    def row(block: int, pos: np.ndarray) -> pa.Table:
        return pa.table({"block": pa.array([block], pa.int32()), "x": pa.array([pos[:, 0]], pa.list_(pa.float64())), "y": pa.array([pos[:, 1]], pa.list_(pa.float64()))})

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                draw = np.random.default_rng(seed)
                draw.bit_generator.advance(2 * size * block)
                yield from row(block, draw.random((min(size, n - size * block), 2))).to_batches()

    def whole(table: pa.Table) -> np.ndarray:
        table = table.sort_by("block")
        return np.stack([table[c].combine_chunks().flatten().to_numpy() for c in ("x", "y")], axis=1)

    def step(t: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            block, pos = key[0].as_py(), whole(left)
            own = np.stack([right[c].to_numpy() for c in ("side", "a", "b")], axis=1).astype(np.int64)
            own = own[np.lexsort((own[:, 2], own[:, 1], own[:, 0]))]
            first = size * block
            return row(block, _step(pos, first, min(first + size, n), own[own[:, 0] == 0, 1:], own[own[:, 0] == 1, 1:], t))

        return run

    state, t = _kept(spark.range(blocks).mapInArrow(begin, schema), schema), 0.1
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to")
    for _ in range(iterations):
        seen = state.select(every, "block", "x", "y").repartition(blocks, "to")
        state = _kept(seen.groupBy("to").cogroup(edges.groupBy("block")).applyInArrow(step(t), schema), schema)
        t -= 0.1 / (iterations + 1)
    bounds = state.agg(*(f(F.expr(f"array_{f.__name__}({c})")).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in "xy"))  # one row

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pos = _scaled(np.stack([r["x"], r["y"]], axis=1), np.array([r["min_x"], r["min_y"]]), np.array([r["max_x"], r["max_y"]]), scale)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pos)) + size * r["block"]), pa.array(pos[:, 0]), pa.array(pos[:, 1])], names=["id", "x", "y"])

    return state.crossJoin(F.broadcast(bounds)).mapInArrow(finish, "id long, x double, y double").join(names, "id").select("node", "x", "y")


def _kept(df: DataFrame, schema: str) -> DataFrame:
    """``df`` as written to the shared folder, once."""
    path = scratch(df.sparkSession, "layout")
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def place_near(e: DataFrame, nodes: DataFrame, passes: int = 6) -> DataFrame:
    """Nodes (node, x, y) without coordinates take the centroid of their placed
    neighbours, each edge counting, with an offset by name; all of a pass at once."""
    links = e.select(F.col("sub").alias("a"), F.col("obj").alias("b")).unionAll(e.select("obj", "sub"))
    dx, dy = text.jitter(F.col("node"))
    near2 = lambda c: F.floor(c * 100 + 0.5) / 100
    for _ in range(passes):
        open_ = nodes.filter("x is null").select(F.col("node").alias("a"))
        near = links.join(open_, "a", "left_semi").join(nodes.filter("x is not null").withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.avg("x").alias("nx"), F.avg("y").alias("ny"))
        near = near.select("node", near2(F.col("nx") + dx).alias("nx"), near2(F.col("ny") + dy).alias("ny"))
        nodes = cut(nodes.join(near, "node", "left").select("node", F.coalesce("x", "nx").alias("x"), F.coalesce("y", "ny").alias("y")))
    return nodes


def place_detached(e: DataFrame, nodes: DataFrame, inner: float = 640.0, outer: float = 1600.0, turn: float = 2.399963, spacing: float = 26.0) -> DataFrame:
    """Components without any coordinates go on a ring, the largest inmost, and
    their members on a small disc; nothing moves where nothing is placed yet."""
    if not nodes.filter("x is not null").limit(1).count():
        return nodes
    lost = nodes.filter("x is null").select("node")
    links = e.select(F.col("sub").alias("a"), F.col("obj").alias("b")).filter("a <> b").join(lost.withColumnRenamed("node", "a"), "a", "left_semi").join(lost.withColumnRenamed("node", "b"), "b", "left_semi")
    links = cut(links)
    found = canon.components(links) if links.limit(1).count() else nodes.sparkSession.createDataFrame([], "node string, root string")
    member = cut(lost.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    rings = positions(member.groupBy("root").agg((-F.count("*")).alias("size")), "size", "root").withColumnRenamed("pos", "i")
    total = rings.agg(F.greatest(F.lit(1), F.count("*") - 1).alias("m"))  # one row
    inside = positions(member, "root", "node")
    begin = inside.groupBy("root").agg(F.min("pos").alias("begin"))
    at = inside.join(begin, "root").join(rings, "root").crossJoin(F.broadcast(total)).withColumn("j", F.col("pos") - F.col("begin"))
    radius = F.sqrt(inner**2 + (outer**2 - inner**2) * F.col("i") / F.col("m"))
    round2 = lambda c: F.floor(c * 100 + 0.5) / 100
    place = lambda f: round2(f(F.col("i") * turn) * radius + f(F.col("j") * turn) * spacing * F.sqrt("j"))
    ring = at.select("node", place(F.cos).alias("x"), place(F.sin).alias("y"))
    return nodes.filter("x is not null").unionByName(ring)


def pagerank(e: DataFrame, damping: float = 0.85, rounds: int = 200) -> DataFrame:
    """Ranks by joins; the rank of nodes without out-links is spread evenly.  Ends
    when the ranks change by less than 1e-10 a node, or after ``rounds``."""
    links = cut(e.select("sub", "obj").distinct())
    degree = links.groupBy("sub").agg(F.count("*").alias("out"))
    nodes = cut(links.select(F.explode(F.array("sub", "obj")).alias("node")).distinct().join(degree, F.col("node") == F.col("sub"), "left").select("node", "out"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        loose = ranks.filter("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("loose"))
        got = links.join(ranks.filter("out is not null").select(F.col("node").alias("sub"), (F.col("rank") / F.col("out")).alias("share")), "sub").groupBy(F.col("obj").alias("node")).agg(F.sum("share").alias("got"))
        new = ranks.join(got, "node", "left").crossJoin(F.broadcast(loose)).select("node", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"), F.col("rank").alias("old"))
        new = cut(new)  # a round reads the last one twice
        ranks = new.drop("old")
        if new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < n * 1e-10:
            break
    return ranks.select("node", "rank")


def layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)


def sage(e: DataFrame, emb: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Mean-aggregating layers over edges (sub, obj): before each, vectors (node, h)
    are normalised, before all but the first also passed through elu."""

    @F.pandas_udf("array<double>")
    def normed(h: pd.Series) -> pd.Series:
        return pd.Series(layer_norm(np.array(h.tolist())).tolist())

    @F.pandas_udf("array<double>")
    def passed(h: pd.Series) -> pd.Series:
        x = layer_norm(np.array(h.tolist()))
        return pd.Series(np.where(x > 0, x, np.expm1(x)).tolist())

    for at, (own, other) in enumerate(weights):
        before = passed if at else normed
        emb = sage_layer(e, cut(emb.select("node", before("h").alias("h"))), own, other)
    return emb


def sage_layer(e: DataFrame, emb: DataFrame, own: np.ndarray, other: np.ndarray) -> DataFrame:
    """own·h + other·mean of the in-neighbours, each edge counting; none gives zeros."""
    dims = own.shape[0]
    means = e.join(emb, F.col("sub") == F.col("node")).groupBy(F.col("obj").alias("to")).agg(F.array(*(F.avg(F.col("h")[i]) for i in range(dims))).alias("m"))

    @F.pandas_udf("array<double>")
    def step(h: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series((np.array(h.tolist()) @ own + np.array([np.zeros(dims) if v is None else v for v in m]) @ other).tolist())

    return emb.join(means, F.col("node") == F.col("to"), "left").select("node", step("h", "m").alias("h"))


def notears(x: np.ndarray, threshold: float = 0.1, l1: float = 0.01, rounds: int = 20, steps: int = 200) -> np.ndarray:
    """Weights of a directed acyclic graph for the columns of ``x`` by an augmented
    Lagrangian with proximal gradient steps; small weights are dropped.  The steps
    of a round end when no weight moves by 1e-7."""
    n, d = x.shape
    w, rho, alpha, h_old = np.zeros((d, d)), 1.0, 0.0, np.inf
    gram = x.T @ x / n

    def acyclic(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = np.eye(d) + w * w / d
        p = np.linalg.matrix_power(m, d - 1)
        return float((p.T * m).sum() - d), p.T * w * 2

    for _ in range(rounds):
        rate = 1 / (np.linalg.norm(gram, 2) + rho)
        for _ in range(steps):
            h, slope = acyclic(w)
            new = w - rate * (gram @ w - gram + (alpha + rho * h) * slope)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            np.fill_diagonal(new, 0)
            moved, w = np.abs(new - w).max(), new
            if moved < 1e-7:
                break
        h, _ = acyclic(w)
        if h < 1e-8:
            break
        alpha += rho * h
        rho = rho * 5 if h > 0.25 * h_old else rho
        rho, h_old = min(rho, 1e12), h
    w[np.abs(w) < threshold] = 0
    return w


def rank_nodes(links: np.ndarray, damping: float = 0.85, rounds: int = 200) -> np.ndarray:
    """PageRank by weight of a small dense graph; the rank of sinks is spread evenly."""
    n = len(links)
    out = links.sum(1)
    rank = np.full(n, 1 / n)
    for _ in range(rounds):
        given = np.where(out > 0, rank / np.where(out > 0, out, 1), 0) @ links + rank[out == 0].sum() / n
        new = (1 - damping) / n + damping * given
        if np.abs(new - rank).sum() < n * 1e-10:
            return new
        rank = new
    return rank


def dag_features(w: np.ndarray) -> np.ndarray:
    """Out and in degree by the largest of both, out and in weight and rank by
    their largest, for each node with an edge; zeros for others."""
    a = np.abs(w)
    some = (a > 0).any(0) | (a > 0).any(1)
    out = np.zeros((len(w), 5))
    if some.any():
        own = a[np.ix_(some, some)]
        top = lambda v: v / v.max() if v.max() > 0 else v
        outs, ins = (own > 0).sum(1), (own > 0).sum(0)
        most = max(outs.max(), ins.max(), 1)
        out[some] = np.stack([outs / most, ins / most, top(own.sum(1)), top(own.sum(0)), top(rank_nodes(own))], axis=1)
    return out


def causal_features(matrix: DataFrame, entities: DataFrame) -> DataFrame:
    """Five features of each of ``entities`` in the graph learned from a window's
    daily presence (window, day, entity, value); zeros where none is learned."""
    names = ("out_degree", "in_degree", "out_weight", "in_weight", "rank")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="day", columns="entity", values="value", fill_value=0.0)
        try:
            w = notears((wide - wide.mean()).to_numpy()) if min(wide.shape) > 1 else np.zeros((wide.shape[1],) * 2)
        except (np.linalg.LinAlgError, FloatingPointError):
            w = np.zeros((wide.shape[1],) * 2)
        return pd.DataFrame({"window": pdf["window"].iloc[0], "entity": wide.columns} | dict(zip(names, dag_features(np.nan_to_num(w)).T, strict=True)))

    found = matrix.groupBy("window").applyInPandas(learn, "window string, entity string, " + ", ".join(f"{c} double" for c in names))
    every = matrix.select("window").distinct().crossJoin(F.broadcast(entities))  # windows by the listed entities
    return every.join(found, ["window", "entity"], "left").na.fill(0.0, list(names))


def dictionary(nodes: DataFrame) -> DataFrame:
    """Dense ids from 1 by name."""
    return positions(nodes.select("node").distinct(), "node").select("node", (F.col("pos") + 1).alias("id"))
