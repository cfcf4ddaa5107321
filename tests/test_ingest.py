"""Fetched feeds, the bucketed ledger, keyed state and daily runs."""

import http.server
import random
import threading
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kgtide.sources import feeds
from kgtide.streaming import daily, ingest, ledger, state

FEED = "<rss><channel><title>F</title>{}</channel></rss>"
ITEM = "<item><title>t{0}</title><link>http://x/{0}</link><pubDate>Tue, 02 Mar 2021 10:00:00 +0000</pubDate></item>"


def plan(spark, urls):
    return spark.createDataFrame([("google_news", str(i), u) for i, u in enumerate(urls)], "source string, item string, url string")


def test_each_fetch_is_tried_again_and_fails_alone(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def fetch(url, seconds):
        tries = len(list(log.glob(f"{url}-*")))
        (log / f"{url}-{tries}").touch()
        if url == "dead" or (url == "shy" and not tries):
            raise TimeoutError(f"{url} after {seconds}")
        return f"<{url}>"

    name = feeds.register(spark, fetch, "trial_feeds")
    feeds.append_plan(plan(spark, ["ok", "shy", "dead", None]), str(tmp_path / "plan"), 0)
    feeds.append_plan(plan(spark, ["later"]), str(tmp_path / "plan"), 7)
    rows = spark.read.format(name).option("pause", 0).option("timeout", 3).load(str(tmp_path / "plan"))
    assert rows.rdd.getNumPartitions() == 5
    got = {r["url"]: (r["batch"], r["body"], r["error"]) for r in rows.collect()}
    assert got == {"ok": (0, "<ok>", None), "shy": (0, "<shy>", None), "dead": (0, None, "TimeoutError: dead after 3.0"), None: (0, None, "LookupError: no address is planned"), "later": (7, "<later>", None)}
    assert len(list(log.glob("dead-*"))) == 2
    assert spark.read.format(name).option("each", 3).load(str(tmp_path / "plan")).rdd.getNumPartitions() == 2
    assert spark.read.format(name).load(str(tmp_path / "none")).count() == 0


def test_feeds_are_fetched_over_http(spark, tmp_path):
    class Server(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            found = self.path == "/good"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/xml; charset=latin-1")
            self.end_headers()
            self.wfile.write("<é>".encode("latin-1"))

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    feeds.append_plan(plan(spark, [f"{base}/good", f"{base}/bad"]), str(tmp_path), 0)
    rows = spark.read.format(feeds.register(spark)).option("tries", 1).load(str(tmp_path)).collect()
    server.shutdown()
    assert {(r["body"], r["error"]) for r in rows} == {("<é>", None), (None, "HTTPError: HTTP Error 404: Not Found")}


def test_a_stream_of_fetches_goes_on_where_it_stopped(spark, tmp_path):
    name = feeds.register(spark, lambda url, seconds: url * 2, "echo_feeds")
    plans, out = str(tmp_path / "plan"), str(tmp_path / "out")
    seen = []

    def batch(rows, k, fail=False):
        rows.write.mode("overwrite").parquet(f"{out}/{k}")
        seen.append(k)
        if fail:
            raise RuntimeError("killed")

    run = lambda fail=False: ingest.run_available(spark.readStream.format(name).load(plans), str(tmp_path / "checkpoint"), lambda r, k: batch(r, k, fail))
    feeds.append_plan(plan(spark, ["a", "b"]), plans, 0)
    run()
    feeds.append_plan(plan(spark, ["c"]), plans, 1)
    with pytest.raises(Exception, match="killed"):
        run(True)
    (tmp_path / "plan" / "batch=0000000009").mkdir()  # not written in full
    run()
    run()
    got = Counter(r["body"] for k in set(seen) for r in spark.read.parquet(f"{out}/{k}").collect())
    assert got == {"aa": 1, "bb": 1, "cc": 1}


def hashes(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "h string")


def test_ledger_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path))
    keys = [f"{i:04x}" for i in range(0, 65536, 97)]
    book.add(hashes(spark, keys[::2]), 0)
    book.add(hashes(spark, keys[1::2]), 1)
    for compacted in (False, True):
        if compacted:
            book.compact(0)
        found = book.among(hashes(spark, ["0a11", "0aff", "ffff"]))
        assert {r["h"] for r in found.collect()} == {k for k in keys if k[:2] in ("0a", "ff")}
        scans = found._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket#" in scans.replace("isnotnull(bucket", "[bucket") or "bucket#" in scans.split("PartitionFilters")[1].split("]")[0]
        assert found.select(F.input_file_name().alias("f")).distinct().filter("not (f like '%bucket=0a%' or f like '%bucket=ff%')").count() == 0


def test_compaction_changes_no_row_and_survives_a_crash(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path))
    assert book.rows().count() == 0 and book.unseen(hashes(spark, ["aa1", "aa1"])).count() == 1
    rng = random.Random(2)
    want = {}
    for k in range(4):
        some = [f"{rng.randrange(600):03x}" for _ in range(200)]
        for _ in range(2):  # run again
            book.add(book.unseen(hashes(spark, some), k), k)
        want |= {h: k for h in some if h not in want}
        assert {r["h"]: r["batch"] for r in book.rows().collect()} == want
    whole = lambda: Counter((r["h"], r["batch"]) for r in book.rows().collect())
    before = whole()
    (tmp_path / "whole" / "upto=3" / "bucket=00").mkdir(parents=True)  # a compaction that was cut off
    assert book.compacted() == -1 and whole() == before
    for upto in (1, 1, 2):
        book.compact(upto)
        assert book.compacted() == upto and whole() == before
    assert sorted(x.name for x in (tmp_path / "new").iterdir() if x.is_dir()) == ["batch=3"]
    book.add(book.unseen(hashes(spark, ["fff", *want]), 4), 4)
    assert whole() - before == {("fff", 4): 1}


def edge_rows(spark, rows, k):
    frame = spark.createDataFrame([(m, "s", "r", o, w, s, u, k) for m, o, w, s, u in rows], state.EDGE)
    return frame.withColumn("ts", F.to_timestamp(F.lit(f"2024-0{k + 1}-01")))


def test_state_survives_a_kill_and_a_repeat(spark, tmp_path):
    path, graph = str(tmp_path / "in"), state.StateGraph(spark, str(tmp_path / "out"))
    source = lambda: spark.readStream.schema(f"{state.EDGE}, ts timestamp").parquet(path)
    rng = random.Random(4)
    want = {}

    def killed(batch):
        raise RuntimeError("killed")

    for k in range(3):
        rows = [("2024-01", f"o{i}", rng.randint(1, 5), rng.choice([None, round(rng.uniform(-1, 1), 4)]), rng.choice([None, float(rng.randint(1, 99))])) for i in rng.sample(range(12), 8)]
        for _, o, w, s, u in rows:
            want[o] = state.fold(want.get(o), [(w, s, u, k)])
        edge_rows(spark, rows, k).write.mode("append").parquet(path)
        if k == 1:
            with pytest.raises(Exception, match="killed"):
                graph.run(source(), buckets=3, fail=killed)
        else:
            graph.run(source(), buckets=3)
    got = {r["obj"]: (r["weight"], r["sentiment"], r["materiality_usd"]) for r in graph.edges().collect()}
    assert got == {o: x[:3] for o, x in want.items()}


def test_a_fold_takes_batches_in_order_and_once():
    rows = [(1, 0.5, None, 1), (2, None, 3.0, 0), (4, -0.25, 9.0, 2)]
    assert state.fold(None, rows) == (7, 0.125, 9.0, 2)
    assert state.fold(state.fold(None, rows), rows[:2]) == (7, 0.125, 9.0, 2)
    assert state.month_end("2023-12") == 1704067200000


def test_state_of_old_months_goes_and_late_edges_fall_away(spark, tmp_path):
    path, graph = str(tmp_path / "in"), state.StateGraph(spark, str(tmp_path / "out"))
    source = lambda: spark.readStream.schema(f"{state.EDGE}, ts timestamp").parquet(path)
    for k, rows in enumerate([[("2024-01", "a", 1, 0.0, None)], [("2024-03", "b", 1, 0.0, None)], [("2024-01", "a", 5, 0.0, None)]]):
        edge_rows(spark, rows, (0, 5, 6)[k]).write.mode("append").parquet(path)
        graph.run(source(), days=30)
    late = edge_rows(spark, [("2024-03", "c", 1, 0.0, None)], 0)
    late.write.mode("append").parquet(path)
    graph.run(source(), days=30)
    # January's state went when June came, so what July brings begins anew; an edge of January's date falls away.
    assert {r["obj"]: r["weight"] for r in graph.edges().collect()} == {"a": 5, "b": 1}


def test_a_daily_run_that_is_killed_is_done_again(spark, tmp_path):
    pages = {"a": FEED.format("".join(ITEM.format(i) for i in range(3))), "b": FEED.format("".join(ITEM.format(i) for i in (2, 3))), "c": "<rss>broken"}
    name = feeds.register(spark, lambda url, seconds: pages[url], "daily_feeds")
    plans, alive = str(tmp_path / "plan"), [False]

    def extract(news):
        if not alive[0]:
            raise RuntimeError("killed")
        kind = {c: F.lit(v) for c, v in {"sub_type": "COMPANY", "rel": "Names", "rel_category": "GMM", "obj": "X", "obj_type": "CONCEPT", "event_type": "other"}.items()}
        return news.select("month", "url", F.lit(0).alias("seq"), F.col("source").alias("sub"), F.lit(0.5).alias("sentiment"), F.lit(None).cast("double").alias("materiality_usd")).withColumns(kind)

    def run():
        daily.DailyRun(spark, plans, str(tmp_path / "out"), extract, name).run(F.lit("2021-03-09").cast("date"))

    feeds.append_plan(plan(spark, ["a"]), plans, 0)
    with pytest.raises(Exception, match="killed"):
        run()
    alive[0] = True
    run()
    feeds.append_plan(plan(spark, ["b", "c", "d"]), plans, 1)
    run()
    run()
    done = daily.DailyRun(spark, plans, str(tmp_path / "out"), extract, name)
    assert sorted((r["url"][-1], r["batch"]) for r in done.articles.articles().collect()) == [("0", 0), ("1", 0), ("2", 0), ("3", 1)]
    assert [(r["month"], r["sub"], r["obj"], r["weight"]) for r in done.graph.edges().collect()] == [("2021-03", "google_news", "X", 4)]
    assert Counter((r["batch"], (r["error"] or "-").split(":")[0]) for r in done.raw().collect()) == {(0, "-"): 1, (1, "-"): 2, (1, "KeyError"): 1}


def test_state_of_a_bucket_is_packed_and_grows_by_what_changes(monkeypatch):
    edges = {(f"s{i}", None if i % 50 == 0 else "r", "o"): (i, None if i % 3 else i / 4, float(i), 2) for i in range(3000)}
    table = state.packed(edges)
    assert state.unpacked(table) == edges and state.unpacked(state.packed({})) == {}
    assert len(table) < 40 * len(edges)

    class Listed(list):
        get, appendValue = list.copy, list.append

        def put(self, rows):
            self[:] = rows

    fold = state.EdgeFold(1)
    fold.state, fold.handle = Listed(), type("Handle", (), {"registerTimer": lambda self, at: None})()
    monkeypatch.setattr(state, "LISTED", 3)
    frame = lambda objs, batch: pd.DataFrame([("2024-01", "s", "r", o, 1, 0.5, None, batch) for o in objs], columns=state.COLUMNS)
    sizes = []
    for batch in range(5):
        list(fold.handleInputRows(("2024-01", 0), iter([frame(range(1000) if batch == 0 else [7, 1000 + batch], batch).astype({"obj": str})]), None))
        sizes.append([len(state.unpacked(t)) for (t,) in fold.state])
    assert sizes == [[1000], [1000, 2], [1000, 2, 2], [1003], [1003, 2]]
    assert state.unpacked(fold.state[-1][0])[("s", "r", "7")][0] == 5
