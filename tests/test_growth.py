"""Steps whose cost must not outgrow their input."""

import ast
import re
import threading
import time

from pyspark.sql import functions as F

import __spark_entry__ as e
from kgtide.functions import text
from kgtide.operators import canon, generate, graph, lineage, serving
from kgtide.operators.textindex import TextIndex
from kgtide.sources import feeds, readers, writers
from kgtide.streaming import daily


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_trimmed_without_patterns(spark, sf_dir):
    odd = ["", " ", " a b ", "\t\n\x0b\f\ra\r\n", "\u00a0a\u00a0", " NaN\t", "none", "a \n b", None]
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select(text.strip(F.col("x")), F.regexp_replace("x", r"^\s+|\s+$", ""), text.norm(F.col("x"), "-")).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]
    assert [r[2] for r in rows] == ["-", "-", "a b", "a", "\u00a0a\u00a0", "-", "-", "a \n b", "-"]
    renamed = plan(e.queries()["ud_canonicalise"](spark, sf_dir))
    assert "regexp_replace" not in renamed and "SortMergeJoin [sub" not in renamed


def test_fetches_of_a_task_wait_together_and_keep_their_order():
    alive, most, lock = [0], [0], threading.Lock()

    def fetch(url, seconds):
        with lock:
            alive[0] += 1
            most[0] = max(most[0], alive[0])
        time.sleep(0.05)
        with lock:
            alive[0] -= 1
        if url.endswith("3"):
            raise FileNotFoundError(url)
        return url

    plans = feeds._Plans({"path": "p", "pause": "0.1"}, fetch)
    rows = list(plans.rows(feeds.Planned([{"batch": 0, "item": str(i), "url": f"u{i}"} for i in range(150)])))
    assert [r[2] for r in rows] == [str(i) for i in range(150)] and 8 < most[0] <= feeds.AT_ONCE
    assert [r[4] for r in rows] == [None if i % 10 == 3 else f"u{i}" for i in range(150)]


def test_a_daily_run_fetches_many_in_a_task(spark, tmp_path):
    name = feeds.register(spark, lambda url, seconds: "<rss><channel><title>t</title></channel></rss>", "many_feeds")
    rows = spark.range(daily.EACH * 2).selectExpr("'s' AS source", "cast(id AS string) AS item", "concat('u', id) AS url")
    feeds.append_plan(rows, str(tmp_path / "plan"), 0)
    run = daily.DailyRun(spark, str(tmp_path / "plan"), str(tmp_path / "out"), lambda news: news, name)
    run._batch = lambda rows, batch, *rest: rows.write.parquet(str(tmp_path / "raw"))
    run.run(F.lit("2021-03-09").cast("date"))
    assert len(list((tmp_path / "raw").glob("part-*"))) == 2
    assert spark.read.parquet(str(tmp_path / "raw")).count() == daily.EACH * 2


def test_an_index_holds_a_trigram_once_for_64_articles(spark, tmp_path):
    a = spark.range(300).selectExpr("'abcd' AS title", "if(id % 7 = 0, 'xyz', null) AS text", "format_string('%04d', id) AS url")
    index = TextIndex(spark, str(tmp_path), "title", "text")
    index.add(a, 0, "url", part_rows=50)
    at = index.segments()[0]
    assert spark.read.parquet(f"{at}/postings").filter("gram = 'abc'").count() == 5
    assert {r["gram"]: r["n"] for r in spark.read.parquet(f"{at}/grams").collect()} == {"abc": 300, "bcd": 300, "xyz": 43}
    assert sorted(r["_doc"] for r in index.candidates(at, ["xyz"]).collect()) == list(range(0, 300, 7))
    assert index.candidates(at, ["abcd", "xyz"]).count() == 300 and index.candidates(at, ["none"]).count() == 0


def test_late_replies_are_waited_for_together(spark):
    def slow(prompt):
        time.sleep(0.5)
        return prompt + "!"

    rows = spark.range(16, numPartitions=1).select("id", generate.reply(slow, F.col("id").cast("string"), 16).alias("r"))
    rows.limit(1).collect()
    begin = time.time()
    assert [r["r"] for r in rows.orderBy("id").collect()] == [f"{i}!" for i in range(16)]
    assert time.time() - begin < 5


def test_vectors_that_meet_are_compared_once_and_do_not_go_with_items(spark):
    v = {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [0.0, 0.0]}
    vectors = spark.createDataFrame(list(v.items()), "vec_id long, v array<double>")
    items = spark.createDataFrame([("a", 0, 2), ("a", 1, 1), ("a", 2, 1), ("b", 0, 3), ("b", 1, 1), ("c", 0, 1)], "url string, seq int, vec_id long")
    pairs = serving.cosine_pairs(items, vectors)
    assert sorted((r["url"], round(r["likeness"], 9)) for r in pairs.collect()) == [("a", 0.6), ("a", 0.6), ("a", 1.0), ("b", 0.0)]
    assert "zip_with" not in plan(pairs)


def test_factors_join_only_the_last_months(spark, sf_dir):
    t = spark.createDataFrame([("2020-01", 1), ("2020-03", 2), ("2020-04", 3), ("2020-04", 4)], "month string, n int")
    assert sorted(r["n"] for r in serving.last_months(t).collect()) == [2, 3, 4]
    assert re.search(r"yyyy-MM[^\n]{0,30}\) IN \(\d{4}-", plan(e.queries()["ap_get_factors"](spark, sf_dir)))


def test_ranks_of_partners_do_not_read_orders(spark, sf_dir):
    assert "o_orderkey" not in plan(e.queries()["pred_mrr_hits"](spark, sf_dir))


def test_written_lists_are_read_without_the_parser(spark, tmp_path, monkeypatch):
    odd = ["", "it's", "a\\", "\\n", "x\ny\r", "), ('", "\u2028\x85", ' "q"', None, "None"]
    ours = [[tuple(odd[(i + j) % len(odd)] for j in range(6)) for i in range(n)] for n in range(12)]
    rows = spark.createDataFrame([(f"u{n}", x, "r") for n, x in enumerate(ours)], f"url string, triplets array<{readers.TRIPLET}>, revised string").repartition(1)
    monkeypatch.setattr(writers, "CANONICAL_A_FILE", 5)
    writers.write_canonical(rows, str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("part-*"))) == 3
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    cells = {r["url"]: r["output_triplets"] for r in back.collect()}
    assert {u: ast.literal_eval(c) for u, c in cells.items()} == {f"u{n}": x for n, x in enumerate(ours)}
    read = back.select("url", readers.parse_triplets(F.col("output_triplets")).alias("t")).collect()
    assert {r["url"]: [tuple(x) for x in r["t"]] for r in read} == {f"u{n}": x for n, x in enumerate(ours)}
    loose = ["[('a', 'b', 'c', 'd', 'e', 'f',)]", "[('a' 'b', 'b', 'c', 'd', 'e', '\\x41')]", "[('a', 'b'), 3]", "[(", "", None]
    assert [readers.literal_items(x) for x in loose] == [[tuple("abcdef")], [("ab", "b", "c", "d", "e", "A")], [], [], [], []]
    monkeypatch.setattr(ast, "literal_eval", lambda x: [])
    assert [readers.literal_items(cells[f"u{n}"]) for n in range(1, 12)] == ours[1:]


def test_edges_are_combined_in_tasks_of_bounded_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 500)
    rows = e.queries()["kg_month_edges"](spark, sf_dir)
    assert rows.rdd.getNumPartitions() == 12  # 6,000 line items
    merged = plan(e.queries()["kg_merge_full"](spark, sf_dir))
    assert len(re.findall(r"Exchange hashpartitioning", merged)) == 1, merged
    odd = spark.createDataFrame([("2020-01", "a", "b", "r", "c")] * 3 + [("2020-01", "a", None, "r", "c"), ("2020-02", "a", "b", "r", "c")], "month string, sub string, obj string, rel string, rel_category string")
    for n in (0, 5, 10_000, 1_000_000):
        got = graph.month_edges(lineage.dealt(odd, n, "sub", "obj")).collect()
        assert sorted((r["month"], r["obj"] or "", r["weight"]) for r in got) == [("2020-01", "", 1), ("2020-01", "b", 3), ("2020-02", "b", 1)]
    assert [lineage.dealt(odd, n, "sub").rdd.getNumPartitions() for n in (500 * 150, 500 * 400, 500 * 4000)] == [150, 200, 1000]


def test_names_are_dealt_before_they_are_spread_and_meet_by_digits(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 1_000)
    parts = []

    def dealt(df, rows, *keys):
        out = lineage.dealt(df, rows, *keys)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(canon, "dealt", dealt, raising=False)
    names = spark.range(200).selectExpr("concat('Supplier#', lpad(id, 9, '0')) AS name")
    pairs = canon.similar_pairs(names)
    assert pairs.count() == 0 and parts == [10]
    assert re.search(r"Join \[gram#\d+, digits#", plan(pairs))
    twice = names.limit(3).unionByName(names.limit(3).selectExpr("concat(name, ' Inc') AS name"))
    assert canon.similar_pairs(twice, 0.7).count() == 3


def test_links_are_packed_by_subject_before_a_month(spark, sf_dir):
    packed = plan(e.queries()["gat_input"](spark, sf_dir))
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#", packed)
    assert sorted(exchanges) == ["month", "sub"], packed


def test_edges_are_not_dealt_by_the_few_names_that_renames_join(spark, sf_dir):
    renamed = plan(e.queries()["canon_rename_merge"](spark, sf_dir))
    assert not re.search(r"Exchange hashpartitioning\((obj|rel)#\d+, \d+\)|SortMergeJoin \[(obj|sub|rel)#\d+\]", renamed), renamed
