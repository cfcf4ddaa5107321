"""Work that is divided as it grows: cells, documents, layouts."""

import glob
import json

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from kgtide.operators import graph, lineage, ml, repulsion
from kgtide.plans import files
from kgtide.sources import bundles, readers, writers
from kgtide.streaming import ingest


def test_a_large_month_is_several_training_rows(spark):
    e = [("2020-01", f"s{i}", "COMPANY", "it's", "SSI", f"o{i % 3}", "UNK", 1.0 + i) for i in range(50)] + [("2020-02", "a", "UNK", "r", "GMM", "b", "UNK", 2.0)]
    e = spark.createDataFrame(e, "month string, sub string, sub_type string, rel string, rel_category string, obj string, obj_type string, w double")
    rows = writers.training_rows(e, 10).collect()
    january = [r for r in rows if r["date"] == "2020-01-15"]
    assert len(january) > 3 and max(r["output_triplets"].count("{") for r in january) < 30
    assert [r["url"] for r in rows if r["date"] == "2020-02-15"] == ["corpus://2020-02"]
    cells = spark.createDataFrame([*((r["date"], r["output_triplets"]) for r in rows), ("bad", "[{"), ("none", None)], "date string, output_triplets string")
    back = readers.weighted_triplets(cells)
    want = e.selectExpr("month || '-15' AS date", "sub", "sub_type", "rel", "rel_category", "obj", "obj_type", "w")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))


def test_bundles_by_lines_are_those_in_one_cell(spark, tmp_path):
    mix = "array(struct('M \"A\"' AS event, 3L AS n), struct('b' AS event, 1L AS n))"
    rows = spark.range(40).selectExpr(
        "if(id % 2 = 0, '2020-12-31', '2021-12-31') AS date", "concat('e\"', id) AS name", "'T' AS type", "cast(id % 3 AS int) AS cluster", "id / 8 AS pc1", "cast(null AS double) AS pc2", "1D AS pc3",
        "struct(1D AS attention, 2D AS sentiment, 3D AS consensus, cast(null AS double) AS novelty, 5D AS materiality) AS factors", "id AS n_articles", f"{mix} AS event_mix", "array('x,', 'y') AS top_partners",
    )
    clustered = rows.groupBy("date", "cluster").agg(F.count("*").cast("int").alias("size"), F.array(F.struct(F.lit("f").alias("factor"), F.lit(0.5).alias("loading"))).alias("signature"), F.array_sort(F.collect_list("name")).alias("members"))
    head = spark.createDataFrame(
        [("c", d, None, 2, ["f"], "n", ["2020-01"], [0.5], [[1.0]], 3, [[0.0]]) for d in ("2020-12-31", "2021-12-31", "1900-12-31")],
        "corpus string, date string, generated_at string, min_articles int, kept_factors array<string>, note string, window_months array<string>, explained_variance array<double>, components array<array<double>>, k int, centroids array<array<double>>",
    )
    bundles.write_lines(bundles.document_lines(rows, clustered, head), str(tmp_path))
    texts = {r["date"]: json.loads(r["value"]) for r in bundles.documents(rows, clustered, head).collect()}
    found = {p.parent.name.removeprefix("date="): p for p in tmp_path.glob("date=*/*.txt")}
    assert {d: json.loads(p.read_text()) for d, p in found.items()} == texts and len(found) == 3
    assert len(found["2020-12-31"].read_text().splitlines()) == 20 + 3 + 3
    whole, lines = bundles.read_documents(spark, str(tmp_path)), bundles.read_lines(spark, str(tmp_path))
    for kind, read in (("head", bundles.heads), ("entity", bundles.entities), ("cluster", bundles.clusters)):
        both = [sorted(map(repr, read(docs).collect())) for docs in (whole, lines.filter(F.col("kind") == kind))]
        assert both[0] == both[1] and both[0]


def test_a_spread_layout_is_that_of_one_task(spark):
    g = np.random.default_rng(5)
    e = [(f"n{a}", f"n{b}") for a, b in g.integers(0, 1100, (2000, 2)).tolist()] + [("é", "n1"), ("n2", "n2")]
    e = spark.createDataFrame(e, "sub string, obj string").repartition(3)
    one = ml.spring_layout(e.withColumn("month", F.lit("m")), 6).select("node", "x", "y")
    spread = ml.spread_layout(e, 6, least=10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, spread.collect()))


def test_a_spread_layout_of_many_nodes_is_that_of_one_task(spark):
    g = np.random.default_rng(6)
    e = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in g.integers(0, 5000, (12_000, 2)).tolist()], "sub string, obj string")
    spread = ml.spread_layout(e, 2)
    one = ml.spring_layout(e.withColumn("month", F.lit("m")), 2).select("node", "x", "y")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, spread.collect()))


def test_nodes_push_each_other_as_in_the_plain_formula():
    pos = np.random.default_rng(3).random((700, 2))
    delta = pos[:, None] - pos[None]
    want = (delta * (0.04 / np.maximum((delta**2).sum(-1), 1e-4))[..., None]).sum(1)
    assert np.allclose(ml._pushed(pos, 0, 700, 0.2), want, rtol=1e-9) and np.array_equal(ml._pushed(pos, 5, 300, 0.2), ml._pushed(pos, 0, 700, 0.2)[5:300])


def test_many_nodes_push_each_other_without_comparing_all(monkeypatch):
    g = np.random.default_rng(3)
    for pos in (g.random((4500, 2)), np.concatenate([g.normal(0, 0.1, (4400, 2)), g.normal(0, 9, (99, 2)), np.zeros((30, 2))]), np.zeros((40, 2)), g.random((2, 2))):
        n = len(pos)
        want, got = ml._pushed(pos, 0, n, 0.2), repulsion.pushed(pos, 0, n, 0.2)
        size = np.sqrt((want**2).sum(-1))
        assert (np.sqrt(((want - got) ** 2).sum(-1)) <= 1e-11 * np.maximum(size, np.median(size))).all()
        assert all(np.array_equal(repulsion.pushed(pos, a, b, 0.2), got[a:b]) for a, b in ((0, 1), (1, 2), (n // 3, n // 2 + 1)))
    pos, edges = g.random((4500, 2)), g.integers(0, 4500, (9000, 2))
    few = ml._step(pos, 0, 50, edges[edges[:, 0] < 50], edges[edges[:, 1] < 50], 0.1)
    monkeypatch.setattr(ml, "_pushed", None)  # all pairs
    assert np.array_equal(ml._step(pos, 0, 4500, edges, edges, 0.1)[:50], few)


def test_a_layouts_months_are_tasks_of_their_own(spark):
    e = spark.range(60).selectExpr("concat('m', id) AS month", "'a' AS sub", "'b' AS obj")
    parts = ml.spring_layout(e, 1).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 50


def test_article_files_are_bounded_and_packed(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(files, "ARTICLES_A_FILE", 100)
    names = glob.glob(files._article_csv(spark, sf_dir).removeprefix("file:") + "/part-*")
    assert len(names) > 5 and all(n.endswith(".csv.gz") for n in names)


def test_batches_of_the_running_graph_are_written_once(spark, sf_dir):
    assert all("Scan ExistingRDD" in e._jdf.queryExecution().executedPlan().toString() for e in files._graph_batches(spark, sf_dir))


def test_all_batches_of_the_running_graph_are_one_pass(spark, sf_dir, monkeypatch):
    passes = []
    monkeypatch.setattr(files, "cut", lambda df: passes.append(df) or lineage.cut(df))
    assert len(files._graph_batches(spark, sf_dir)) == 3 and len(passes) == 1


def test_a_commit_writes_its_own_edges_alone(spark, tmp_path):
    g = np.random.default_rng(8)
    schema = "month string, sub string, rel string, obj string, weight long, sentiment double, materiality_usd double"
    some = lambda p, x: None if g.random() < p else x
    store, merged = ingest.GraphStore(spark, str(tmp_path)), None
    for k, n in enumerate((60, 40, 5, 50)):
        rows = {(f"m{g.integers(2)}", some(0.1, f"s{g.integers(9)}"), "r", f"o{g.integers(5)}"): (int(g.integers(1, 9)), some(0.3, round(float(g.uniform(-1, 1)), 4)), some(0.3, float(g.integers(99)))) for _ in range(n)}
        e = spark.createDataFrame([(*key, *x) for key, x in rows.items()], schema)
        merged = e if merged is None else lineage.cut(graph.pair_merge(merged, e, "month"))
        for _ in range(2):
            store.commit(e, graph.ends(e, "month").select("month", "node").distinct().withColumn("type", F.lit(str(k))), k)
        written = [p for p in tmp_path.rglob("*.parquet") if f"batch={k}" in str(p) and "edge" in str(p)]
        assert sum(pq.read_metadata(p).num_rows for p in written) == len(rows)
    assert sorted(map(repr, store.edges().collect())) == sorted(map(repr, merged.collect()))
    assert store.edges(1).count() < store.edges(3).count() and store.nodes().groupBy("month", "node").count().filter("count > 1").count() == 0
