"""Bundle documents, the table function, and late rows."""

import json

import pytest
from pyspark.sql import functions as F

from kgtide.operators import factors, generate, ml
from kgtide.sources import bundles
from kgtide.streaming import ingest, late

WHOLE = {
    "generated_at": "2026-01-02T03:04:05+00:00", "min_articles": 2, "kept_factors": ["sentiment"], "corpus": "c", "date": "2026-01-02", "window_months": ["2025-12", "2026-01"],
    "entities": [{"name": 'A "b"', "type": "COMPANY", "cluster": 1, "pc1": 1.5, "pc2": -0.25, "pc3": 0.0, "factors": {"attention": 2.0, "sentiment": 0.5, "consensus": 1.0, "novelty": 1.0, "materiality": 0.0}, "n_articles": 2, "event_mix": [["OTHER", 3], ["MACRO", 1]], "top_partners": ["x", "y, z"]}],
    "pca": {"explained_variance": [1.0], "components": [[1.0]]}, "kmeans": {"k": 1, "centroids": [[0.5]], "clusters": [{"cluster": 1, "size": 1, "signature": [{"factor": "sentiment", "loading": 0.5}], "members": ['A "b"']}]},
}
EMPTY = {"generated_at": "x", "min_articles": 2, "kept_factors": ["attention"], "entities": [], "pca": {"explained_variance": [], "components": []}, "kmeans": {"k": 0, "centroids": []}, "note": "Only 1 entity.", "corpus": "c", "date": "2026-01-03"}


def test_documents_of_both_kinds_are_read(spark, tmp_path):
    for name, text in (("a", json.dumps(WHOLE, indent=2)), ("b", json.dumps(EMPTY)), ("c", "{not json")):
        (tmp_path / f"{name}.json").write_text(text)
    docs = bundles.read_documents(spark, str(tmp_path))
    heads = {r["date"]: r for r in bundles.heads(docs).collect()}
    assert heads["2026-01-02"]["window_months"] == ["2025-12", "2026-01"] and heads["2026-01-02"]["note"] is None and heads["2026-01-02"]["k"] == 1
    assert heads["2026-01-03"]["note"] == "Only 1 entity." and heads["2026-01-03"]["components"] == [] and len(heads) == 2
    (one,) = bundles.entities(docs).collect()
    assert one["name"] == 'A "b"' and [tuple(x) for x in one["event_mix"]] == [("OTHER", 3), ("MACRO", 1)] and one["factors"]["sentiment"] == 0.5 and one["top_partners"] == ["x", "y, z"]
    (cluster,) = bundles.clusters(docs).collect()
    assert cluster["members"] == ['A "b"'] and cluster["signature"][0]["loading"] == 0.5


def test_a_bundle_written_and_read_is_what_was_found(spark, tmp_path):
    rows = [("2020-01", f"e{i}", "r", f"o{i % 5}", 1 + i % 7, (i % 9 - 4) / 5, float(i % 4) * 1000, "OTHER" if i % 3 else 'M "A"') for i in range(40)]
    e = spark.createDataFrame(rows, "month string, sub string, rel string, obj string, weight long, sentiment double, materiality_usd double, event_type string")
    f = factors.snapshot_factors(e)
    found = ml.pca_kmeans(f)
    types = spark.createDataFrame([(f"e{i}", "COMPANY") for i in range(39)], "node string, type string")
    parts = bundles.of_factors(found, f, factors.event_mix(e), factors.top_partners(e), types, "c", "2020-01-31", "now", ["2020-01"])
    text = bundles.documents(*parts)
    doc = json.loads(text.first()["value"])
    assert doc["kept_factors"] == found["kept"] and doc["kmeans"]["k"] == found["k"] == len(doc["kmeans"]["clusters"]) and doc["date"] == "2020-01-31"
    assert sorted(m for c in doc["kmeans"]["clusters"] for m in c["members"]) == sorted(x[1] for x in rows if x[4] > 1) and all(len(c["members"]) == c["size"] for c in doc["kmeans"]["clusters"])
    for c in doc["kmeans"]["clusters"]:
        assert {(x["factor"], x["loading"]) for x in c["signature"]} == set(found["signatures"][c["cluster"]])
    bundles.write_documents(text, str(tmp_path))
    back = {r["name"]: r for r in bundles.entities(bundles.read_documents(spark, str(tmp_path))).collect()}
    for r in found["entities"].collect():
        assert (back[r["sub"]]["cluster"], back[r["sub"]]["pc1"], back[r["sub"]]["pc2"]) == (r["cluster"], r["pc1"], r["pc2"])
    assert [tuple(x) for x in back["e3"]["event_mix"]] == [('M "A"', 4)] and back["e39"]["type"] == "UNK"
    few = ml.pca_kmeans(f.limit(2))
    empty = bundles.documents(*bundles.of_factors(few, f.limit(2), factors.event_mix(e), factors.top_partners(e), types, "c", "2020-02-29", "now", []))
    doc = json.loads(empty.first()["value"])
    assert doc["entities"] == [] and doc["note"] == "too few entities" and doc["kmeans"] == {"k": 0, "centroids": [], "clusters": []}


def test_a_table_function_gives_triplets_or_the_error(spark):
    calls = []

    def reply(prompt):
        calls.append(prompt)
        if "bad" in prompt:
            raise ValueError("no")
        return "[('a', 'T', 'r', 'c', 'b', 'U'), ('short',), ('d', 'T', 'r', 'c', 'e', 'U')]" if "two" in prompt else "[]"

    spark.udtf.register("trial_extract", generate.extract_table(reply, "do {input_text_}", literal=True, pause=0))
    spark.createDataFrame([(1, "T", "two"), (2, None, "none"), (3, "bad", None), (4, None, None)], "id int, title string, text string").createOrReplaceTempView("trial_articles")
    got = spark.sql("SELECT id, seq, sub, obj, sentiment, error FROM trial_articles, LATERAL trial_extract(title, text)").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "a", "b", None, None), (1, 1, "d", "e", None, None), (3, None, None, None, None, "ValueError: no")]


def run(source, root, spark):
    put = lambda rows, k: rows.write.mode("overwrite").parquet(f"{root}/rows/batch={k}")
    ingest.run_available(source, f"{root}/checkpoint", put)
    return spark.read.parquet(f"{root}/rows")


def files(spark, path, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(path)


def test_which_late_rows_fall(spark, tmp_path):
    at = lambda day, hour=0: f"2024-03-{day:02} {hour:02}:00:00"
    parts = [
        [("a", at(1)), ("a", at(1, 5)), ("b", at(4))],  # one a; the watermark comes to the 2nd
        [("c", at(3)), ("b", at(5)), ("e", at(9))],  # b is known; the watermark comes to the 7th
        [("d", at(1)), ("a", at(2, 1)), ("e", at(10))],  # d is older than the 2nd and falls; a and e are known
        [("g", at(6)), ("f", at(8)), ("a", at(8))],  # g is older than the 7th and falls; a is known no more
    ]
    files(spark, str(tmp_path / "in"), parts, "url string, ts string")
    source = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(late.once(source), str(tmp_path / "out"), spark)
    assert sorted((r["url"], r["ts"].day) for r in got.collect()) == [("a", 1), ("a", 8), ("b", 4), ("c", 3), ("e", 9), ("f", 8)]


def test_articles_wait_for_their_triplets(spark, tmp_path):
    at = lambda day, hour=0: f"2024-03-{day:02} {hour:02}:00:00"
    files(spark, str(tmp_path / "a"), [[("u", at(1), "U"), ("v", at(1), "V"), ("w", at(2), "W")], [("x", at(9), "X")]], "url string, ts string, title string")
    files(spark, str(tmp_path / "t"), [[("u", at(1, 3), "s1"), ("u", at(1, 9), "s2"), ("v", at(3), "too late"), ("w", at(2, 1), "s3")], [("y", at(9), "s4")]], "url string, ts string, sub string")
    stream = lambda name, last: spark.readStream.schema(f"url string, ts timestamp, {last} string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    got = run(late.with_triplets(stream("a", "title"), stream("t", "sub")), str(tmp_path / "out"), spark)
    assert sorted((r["title"], r["sub"]) for r in got.filter("title <> 'X'").collect() if r["sub"]) == [("U", "s1"), ("U", "s2"), ("W", "s3")]
    assert [r["sub"] for r in got.filter("title = 'V'").collect()] == [None]
