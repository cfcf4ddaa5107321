"""Operators that SQL does not express, against brute force."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgtide.functions import text
from kgtide.operators import canon, factors, generate, graph, ml, naming, search, serving
from kgtide.sources import readers, writers
from kgtide.streaming import ingest

R = random.Random(3)


def lcs(a, b):
    best = {(-1, -1): 0}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            here = best.get((i - 1, j - 1), 0) + 1 if x == y else 0
            best[i, j] = max(here, best.get((i - 1, j), 0), best.get((i, j - 1), 0))
    return best.get((len(a) - 1, len(b) - 1), 0)


def test_lcs_ratio():
    for _ in range(200):
        a, b = ("".join(R.choice("abc") for _ in range(R.randint(0, 9))) for _ in range(2))
        assert canon.lcs_ratio(a, b) == (round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100)


def greedy_relations(freq, least=92):
    """Case variants to the commonest, then the greedy pass from the commonest on."""
    by = defaultdict(list)
    for r in freq:
        by[r.lower().strip()].append(r)
    reps = {low: min(vs, key=lambda v: (-freq[v], v)) for low, vs in by.items()}
    out = {v: reps[low] for low, vs in by.items() for v in vs if v != reps[low]}
    order, merged = sorted(reps.values(), key=lambda r: (-freq[r], r)), {}
    for i, a in enumerate(order):
        if a not in merged:
            for b in order[i + 1 :]:
                if b not in merged and round(200 * lcs(a.lower().strip(), b.lower().strip()) / (len(a.strip()) + len(b.strip()))) >= least:
                    merged[b] = a
    return out | merged


def test_relation_merge(spark):
    base = ["negative impact on", "positive impact on", "invests in shares of", "is component of the", "ab", "a", "competes with firmly", "experiences price increase"]
    freq = {}
    for x in base:
        for _ in range(14):
            y = list(x)
            for _ in range(R.randint(0, 3)):
                at = R.randrange(max(1, len(y)))
                y[at : at + 1] = R.choice(["", "".join(y[at : at + 1]) + "s", "".join(y[at : at + 1]).upper(), "x"])
            if "".join(y).strip():
                freq["".join(y)] = R.randint(1, 9)
    want = greedy_relations(freq)
    assert len(want) > 30
    got = naming.relation_merge(spark.createDataFrame(list(freq.items()), "rel string, n long"))
    assert {r["name"]: r["canonical"] for r in got.collect()} == want
    assert naming.relation_merge(spark.createDataFrame([], "rel string, n long")).count() == 0


def test_clean_map_goes_through_tickers_suffixes_and_likeness(spark):
    names = spark.createDataFrame(
        [("AZN.L", 5, "STOCK_TICKER"), ("LSE:AZN", 1, "UNK"), ("AstraZeneca PLC", 9, "COMPANY"), ("AstraZeneca", 2, "COMPANY"), ("astrazeneca shares", 1, "CONCEPT"), ("Q3 results", 50, "EVENT"), ("V", 1, "COMPANY"),
         ("Bristol-Myers Squibb", 4, "COMPANY"), ("Bristol Myers Squibb Co", 1, "ORG"), ("International Business Machines", 8, "COMPANY"), ("International Business Machine", 1, "COMPANY"), ("BP", 1, "COMPANY"), ("BP p.l.c.", 3, "ORG"), ("Comcast Corp. Cl A", 1, "COMPANY"), ("Comcast", 2, "COMPANY")],
        "name string, freq long, type string",
    )
    companies = spark.createDataFrame([(0, "AZN.L", "AstraZeneca"), (1, "V", "Visa")], "ord int, ticker string, company string")
    got = {r["name"]: r["canonical"] for r in naming.clean_map(names, companies).collect()}
    assert got == {
        "AZN.L": "AstraZeneca PLC", "LSE:AZN": "AstraZeneca PLC", "AstraZeneca": "AstraZeneca PLC", "astrazeneca shares": "AstraZeneca PLC", "Bristol Myers Squibb Co": "Bristol-Myers Squibb",
        "International Business Machine": "International Business Machines", "BP": "BP p.l.c.", "Comcast Corp. Cl A": "Comcast",
    }


def test_suffix_key_reaches_its_fixpoint(spark):
    rows = spark.createDataFrame([("A Co Inc. Ltd. Corp. Group Holdings. PLC. & Co. SA.",), ("The Walt Disney Company (The)",), ("x",), ("",), ("Merck & Co.",)], "name string")
    assert [r[0] for r in rows.select(text.suffix_key(F.col("name"))).collect()] == ["a", "walt disney", "x", "", "merck"]


def test_labels_and_scales(spark):
    rows = spark.createDataFrame([("2020-03", "2021-06"), ("2020-03", "2020-03"), (None, "x"), (None, None), ("2020-13", None)], "a string, b string")
    got = rows.select(text.month_label(F.col("a")), text.range_label(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("Mar 2020", "Mar 2020 → Jun 2021"), ("Mar 2020", "Mar 2020"), ("—", "x"), ("—", "—"), ("2020-13", "2020-13")]
    one = spark.range(1).select(text.rescale(F.lit(99), 1, 15, 0.6, 4), text.rescale(F.lit(8), 1, 15, 0, 14), text.rescale(F.lit(-5), 1, 15, 0.6, 4)).first()
    assert tuple(one) == pytest.approx((4, 7, 0.6))
    empty = spark.createDataFrame([], "x double, y double")
    assert tuple(serving.bounds(empty).first()) == (-1, 1, -1, 1)


def test_positions_are_global_and_stable(spark):
    rows = [(R.randint(0, 50), i) for i in range(3000)]
    got = {(r["a"], r["b"]): r["pos"] for r in graph.positions(spark.createDataFrame(rows, "a int, b int").repartition(7), F.desc("a"), "b").collect()}
    assert [got[x] for x in sorted(rows, key=lambda x: (-x[0], x[1]))] == list(range(3000))


def test_small_graphs_label_all(spark):
    d = spark.createDataFrame([(f"n{i:03}", i % 40) for i in range(300)], "node string, degree int")
    count = lambda parts, **k: graph.label_budget(d, (F.substring("node", 2, 3).cast("int") % parts), **k).count()
    assert count(8) == 300 and count(1, all_up_to=300) == 300 and count(1) == 120
    assert count(7, least=1, share=0.0) in range(7, 9)


# ---------------------------------------------------------------- files and streams


def test_literal_cells(spark):
    cells = [None, "", "[", "5", "[('a','T','r','c','b','T'), ('x',), ['c','T','r','c','d',None]]", "```python\n[(' a ','T','r','c','b','T')]\n```", "[('it\\'s','T','r, s','c','\"b\"','T')]"]
    got = [readers.literal_items(c, True) for c in cells]
    assert [len(x) for x in got] == [0, 0, 0, 0, 2, 1, 1] and got[5][0][0] == "a" and got[6][0][0] == "it's" and got[4][1][5] is None
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(readers.parse_triplets(F.col("c")).alias("t"))
    again = rows.select("t", readers.parse_triplets(writers.tuples_literal(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in again)


def test_enriched_replies():
    good = '{"sub": " a ", "sub_type": "", "rel": "r", "obj": "o", "obj_type": "T"'
    cases = {
        None: [], "": [], "no": [], "[1, {}]": [], f"x [{good}}}] y": [(" a ", 0.0, None, "OTHER", "UNK")], f'[{good}, "sentiment": "x", "materiality_usd": -1, "event_type": 3}}]': [(" a ", 0.0, None, "OTHER", "UNK")],
        f'[{good}, "sentiment": 3, "materiality_usd": 2, "event_type": "E", "rel_category": "C"}}]': [(" a ", 3.0, 2.0, "E", "C")], f'[{good}, "sub": 5}}]': [],
    }
    for raw, want in cases.items():
        assert [(x["sub"], x["sentiment"], x["materiality_usd"], x["event_type"], x["rel_category"]) for x in readers.enriched_items(raw)] == want


def test_missing_columns_and_months(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "url string")
    with pytest.raises(ValueError, match="date"):
        readers.require(df, ["url", "date"])
    assert readers.read_month(spark, str(tmp_path / "none"), "2020-01", "url string, month string").count() == 0


def test_feeds_are_read_and_a_broken_one_hinders_none(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><title>T &amp; U</title>\n<item><title>x</title><link>l</link><pubDate>Tue, 02 Jan 2024 23:00:00 -0200</pubDate></item><item><title>y</title><link>m</link></item></channel></rss>")
    (tmp_path / "b.xml").write_text("<rss><channel><item><title>z")
    (tmp_path / "c.xml").write_text("<rss><channel><title></title></channel></rss>")
    raw = readers.read_feeds(spark, str(tmp_path))
    got = readers.rss_items(raw, F.lit("2024-05-05").cast("date")).select("ord", "title", "url", "source", F.col("date").cast("string"), "text").collect()
    assert sorted(map(tuple, got)) == [(0, "x", "l", "T & U", "2024-01-03", "x"), (1, "y", "m", "T & U", "2024-05-05", "y")]
    assert [r["path"][-5:] for r in readers.broken_feeds(raw).collect()] == ["b.xml"]


def test_a_killed_batch_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    store = ingest.MonthStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("u1", "2020-01-05"), ("u2", "2020-02-05"), ("u1", "2020-01-05")], "url string, date string")
    writer, calls = type(rows.write), []
    real = writer.parquet

    def dies(self, path, *a, **k):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("killed between the writes")
        return real(self, path, *a, **k)

    monkeypatch.setattr(writer, "parquet", dies)
    with pytest.raises(OSError, match="killed"):
        store.commit(rows, 0)
    monkeypatch.setattr(writer, "parquet", real)
    store.commit(rows, 0)
    store.commit(rows.unionByName(spark.createDataFrame([("u3", "2020-02-06")], "url string, date string")), 1)
    store.commit(rows.unionByName(spark.createDataFrame([("u3", "2020-02-06")], "url string, date string")), 1)
    assert sorted((r["url"], r["month"], r["batch"]) for r in store.articles().collect()) == [("u1", "2020-01", 0), ("u2", "2020-02", 0), ("u3", "2020-02", 1)]
    assert store.count() == 3


def test_running_graph_keeps_nodes_and_folds_edges(spark, tmp_path):
    store = ingest.GraphStore(spark, str(tmp_path))
    edge = lambda *rows: spark.createDataFrame(rows, "month string, sub string, rel string, obj string, weight long, sentiment double, materiality_usd double")
    node = lambda *rows: spark.createDataFrame(rows, "month string, node string, type string")
    store.commit(edge(("m1", "a", "r", "b", 1, 1.0, 5.0), ("m2", "a", "r", "b", 1, 0.5, 0.0)), node(("m1", "a", "old"), ("m2", "a", "two")), 0)
    for _ in range(2):
        store.commit(edge(("m1", "a", "r", "b", 2, 0.0, 7.0), ("m1", "c", "r", "b", 1, -1.0, 0.0)), node(("m1", "a", "new"), ("m1", "c", "new")), 1)
    assert sorted(map(tuple, store.edges().select("month", "sub", "weight", "sentiment", "materiality_usd").collect())) == [("m1", "a", 3, 0.5, 7.0), ("m1", "c", 1, -1.0, 0.0), ("m2", "a", 1, 0.5, 0.0)]
    assert sorted(map(tuple, store.nodes().select("month", "node", "type").collect())) == [("m1", "a", "old"), ("m1", "c", "new"), ("m2", "a", "two")]


def test_windows_and_sessions_on_a_stream(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for n, build in enumerate((lambda e: ingest.windowed_counts(e, "1 day", late="400 days"), lambda e: ingest.sessions(e, "6 hours"))):
        q = build(stream).writeStream.format("memory").queryName(f"w{n}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        cols = [c for c in spark.table(f"w{n}").columns if c != "v"]
        assert Counter(map(tuple, spark.table(f"w{n}").select(cols).collect())) == Counter(map(tuple, build(events).select(cols).collect()))


# ---------------------------------------------------------------- generated replies


def test_retry_timeout_and_failing_open(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) % 2:
            raise generate.RateLimited("slow down")
        return "ok"

    assert generate.with_retry(flaky, 0)("x") == "ok" and len(calls) == 2
    with pytest.raises(generate.RateLimited):
        generate.with_retry(flaky, 0, on=KeyError)("x")
    assert generate.with_timeout(lambda p: time.sleep(5) or "late", 0.05)("x") == "[]"
    assert generate.with_timeout(lambda p: "soon", 5)("x") == "soon"
    with pytest.raises(KeyError):
        generate.with_timeout(lambda p: {}[p], 5)("x")
    t = spark.createDataFrame([("u", 0, "a", "r", "b")], "url string, seq long, sub string, rel string, obj string")
    fails = lambda names: 1 / 0
    assert generate.canonicalise(t, fails, []).collect() == t.collect()
    assert generate.canonicalise(t, lambda n: 'x {"a": "b"} y', []).count() == 0
    assert generate.renames('{"a": "b", "c": "c", "d": 1, "e": " "}') == {"a": "b"} and generate.renames("{") == {} and generate.renames("[1]") == {}
    empty = spark.createDataFrame([], "rank int, title string, date string, ticker string, summary string, url string")
    assert generate.chat_prompt(empty, "Q").first()["prompt"] == "_No matching articles found._\n\n---\n\nAnalyst question:\nQ"


def test_prompts_name_a_title_once(spark):
    rows = spark.createDataFrame([("T", "a T b"), ("T", "body"), (None, "body"), ("T", ""), (None, None)], "title string, text string")
    got = [r[0] for r in rows.select(generate.prompt("<{input_text_}>", F.col("title"), F.col("text"))).collect()]
    assert got == ["<a T b>", "<T\n\nbody>", "<body>", "<T>", "<>"]


# ---------------------------------------------------------------- graphs and models


def fnv(s):
    h = 0x811C9DC5
    raw = s.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return h


def jitter(s):
    angle, radius = fnv(s) % 3600 / 3600 * 2 * math.pi, 18 + (fnv(s) >> 12) % 60
    return math.cos(angle) * radius, math.sin(angle) * radius


def slow_layout(nodes, edges, anchor, passes=6):
    r2 = lambda x: math.floor(x * 100 + 0.5) / 100
    pos, near = dict(anchor), defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    for _ in range(passes):
        new = {}
        for n in nodes:
            there = [pos[x] for x in near[n] if x in pos]
            if n not in pos and there:
                new[n] = tuple(r2(sum(p[k] for p in there) / len(there) + jitter(n)[k]) for k in (0, 1))
        pos |= new
    left, parts = {n for n in nodes if n not in pos}, []
    while left:
        todo, part = [min(left)], []
        left -= set(todo)
        while todo:
            part.append(todo.pop())
            more = [x for x in near[part[-1]] if x in left]
            left -= set(more)
            todo += set(more)
        parts.append(sorted(part))
    parts.sort(key=lambda p: (-len(p), p[0]))
    for i, part in enumerate(parts):
        r, a = math.sqrt(640**2 + (1600**2 - 640**2) * (i / max(1, len(parts) - 1))), i * 2.399963
        for j, n in enumerate(part):
            pos[n] = tuple(r2(f(a) * r + f(j * 2.399963) * 26 * math.sqrt(j)) for f in (math.cos, math.sin))
    return pos


def test_merged_layout(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("c0", "c0"), ("c1", "c0")]
    apart = [("x1", "x2"), ("x2", "x3"), ("y1", "y2"), ("z", "z")]
    anchor = {"c0": (1.0, 2.0), "c1": (3.0, 4.5)}
    nodes = sorted({n for e in chain + apart for n in e})
    e = spark.createDataFrame(chain + apart, "sub string, obj string")
    got = serving.placed_graph(e, spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame([(n, *p) for n, p in anchor.items()], "node string, x double, y double"))
    want = slow_layout(nodes, chain + apart, anchor)
    found = {r["node"]: (r["x"], r["y"]) for r in got.collect()}
    assert set(found) == set(want) == set(nodes)
    for n in nodes:
        assert found[n] == pytest.approx(want[n], abs=0.011), n


def test_sage_layers(spark):
    g = np.random.default_rng(2)
    h, e = g.standard_normal((7, 4)), [(0, 1), (0, 1), (2, 1), (3, 4), (4, 4), (5, 0)]
    weights = [(g.standard_normal((4, 4)), g.standard_normal((4, 4))) for _ in range(2)]
    got = ml.sage(spark.createDataFrame([(str(a), str(b)) for a, b in e], "sub string, obj string"), spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(h)], "node string, h array<double>"), weights)
    x = h
    for at, (own, other) in enumerate(weights):
        x = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
        x = np.where(x > 0, x, np.expm1(x)) if at else x
        mean = np.stack([np.mean([x[a] for a, b in e if b == i], axis=0) if any(b == i for _, b in e) else np.zeros(4) for i in range(7)])
        x = x @ own + mean @ other
    assert np.allclose(np.array([r["h"] for r in sorted(got.collect(), key=lambda r: r["node"])]), x)


def test_causal_graph_and_features(spark):
    g = np.random.default_rng(4)
    a = g.standard_normal(800)
    b = 1.5 * a + 0.3 * g.standard_normal(800)
    c = -1.2 * b + 0.3 * g.standard_normal(800)
    w = ml.notears(np.stack([a, b, c, g.standard_normal(800)], axis=1) - 0)
    assert {(i, j) for i, j in zip(*np.nonzero(w), strict=True)} >= {(0, 1), (1, 2)} and not np.linalg.matrix_power((w != 0).astype(int), 4).any()
    f = ml.dag_features(np.array([[0, 2.0, 0, 0], [0, 0, -1.0, 0], [0, 0, 0, 0], [0, 0, 0, 0]]))
    assert f[:, :4].tolist() == [[1, 0, 1, 0], [1, 1, 0.5, 1], [0, 1, 0, 0.5], [0, 0, 0, 0]]
    assert f[2, 4] == 1 and f[0, 4] < f[1, 4] < 1 and f[3, 4] == 0
    days = [("w1", d, n) for d in range(40) for n in ("p", "q") if R.random() < 0.6] + [("w2", 1, "p")]
    m = spark.createDataFrame(days, "window string, day int, entity string").withColumn("value", F.lit(1.0))
    got = {(r["window"], r["entity"]): r["rank"] for r in ml.causal_features(m, spark.createDataFrame([("p",), ("q",), ("z",)], "entity string")).collect()}
    assert set(got) == set(itertools.product(("w1", "w2"), "pqz")) and got["w2", "p"] == got["w1", "z"] == 0


def test_layouts_are_bounded_and_repeatable(spark):
    e = spark.createDataFrame([("m1", "a", "b"), ("m1", "b", "c"), ("m1", "d", "d"), ("m2", "a", "z")], "month string, sub string, obj string")
    one, two = (sorted(map(tuple, ml.spring_layout(e, 30).collect())) for _ in range(2))
    assert one == two and {(m, n) for m, n, *_ in one} == {("m1", x) for x in "abcd"} | {("m2", "a"), ("m2", "z")}
    assert all(0 <= v <= 1000 for *_, x, y in one for v in (x, y))


def test_bundle_is_that_of_numpy(spark):
    g = np.random.default_rng(6)
    centres = g.standard_normal((3, 5)) * 8
    x = np.concatenate([c + 0.2 * g.standard_normal((8, 5)) for c in centres])
    rows = [(f"e{i}", 3, *map(float, v)) for i, v in enumerate(x)]
    f = spark.createDataFrame(rows, "sub string, attention long, a0 double, sentiment double, consensus double, novelty double, materiality double").withColumn("attention", (F.col("a0") * 100 + 5000).cast("long"))
    bundle = ml.pca_kmeans(f.drop("a0"))
    z = np.array([[r["attention"], *x[int(r["sub"][1:]), 1:]] for r in sorted(f.collect(), key=lambda r: int(r["sub"][1:]))], float)
    z = (z - z.mean(0)) / z.std(0)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(bundle["explained"], (s**2 / (s**2).sum())[:3], atol=1e-9)
    assert np.allclose(np.abs(np.array(bundle["components"])), np.abs(v[:3]), atol=1e-7)
    assert all(c[np.abs(c).argmax()] > 0 for c in np.array(bundle["components"]))
    label = {int(r["sub"][1:]): r["cluster"] for r in bundle["entities"].collect()}
    assert bundle["k"] == 5 and all(label[i] != label[j] for i, j in itertools.combinations(range(24), 2) if i // 8 != j // 8)
    assert all(len(s) == 3 and [abs(v) for _, v in s] == sorted((abs(v) for _, v in s), reverse=True) for s in bundle["signatures"])
    few = ml.pca_kmeans(f.drop("a0").limit(3))
    assert few["entities"] is None and few["note"] == "too few entities"
    same = f.drop("a0").select("sub", F.lit(5).alias("attention"), *(F.lit(1.0).alias(c) for c in factors.FACTORS[1:]))
    assert ml.pca_kmeans(same)["note"] == "no factor varies"


def test_hits_are_scored_with_and_without_a_ticker(spark):
    a = spark.createDataFrame([("u1", "Steel deal", "AAPL rises", "AAPL", "2020-01-02", "2020-01"), ("u2", "other", "steel", "MSFT", "2020-02-02", "2020-02")], "url string, title string, summary string, ticker string, date string, month string")
    urls = lambda *x: [r["url"] for r in search.search(a, *x).collect()]
    assert urls("steel of") == ["u1", "u2"] and urls("steel", "MSFT") == ["u2"] and urls("rare", "aapl rises now") == [] and urls("", "aapl") == ["u1"] and urls("", None, "2020-02") == ["u2"]
