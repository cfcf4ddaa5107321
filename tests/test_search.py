"""The trigram index and the similarity join."""

import random

from pyspark.sql import functions as F

from kgtide.operators import canon, search
from kgtide.operators.textindex import TextIndex

COLS = "url string, title string, text string, date string, month string, ticker string"


def news(spark, n=1500):
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(400)] + ["İstanbul", "Straße", "日本語"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(30)) + (" quasarling" if i in (7, 700, 701) else "")
        rows.append((f"u{i:04}", rng.choice(["Title", None, "The Quasarling"]) if i % 150 == 0 else f"t{i}", text if i % 97 else None, f"2020-{1 + i * 12 // n:02}-01", f"2020-{1 + i * 12 // n:02}", "T"))
    return spark.createDataFrame(rows, COLS)


def test_an_index_reads_the_parts_of_its_candidates(spark, tmp_path):
    a = news(spark)
    index = TextIndex(spark, str(tmp_path), "title", "text")
    index.add(a.filter("month <= '2020-06'"), 0, "date", "url", part_rows=64)
    for _ in range(2):
        index.add(a.filter("month > '2020-06'"), 1, "date", "url", part_rows=64)
    index.add(a.filter("false"), 2, "date", "url")
    assert len(index.segments()) == 3
    for terms in (["quasarling"], ["w17x", "QUASAR"], ["w3x w4x"], ["日本語"], ["i̇stanbul", "straße"], ["nothing at all"], ["w1"], [], ["x w"]):
        low = F.concat_ws("\n", F.lower("title"), F.lower("text"))
        want = {r["url"] for r in a.filter(F.greatest(*(F.contains(low, F.lit(t.lower())) for t in terms), F.lit(False))).collect()} if terms else {r["url"] for r in a.collect()}
        got = {r["url"] for r in index.matching(terms).collect()}
        assert want <= got, terms
        if terms == ["quasarling"]:
            assert got == want and len(want) > 3
    for q in ("quasarling", "w17x QUASAR", "w1 w2"):
        rows = lambda frame: [tuple(r) for r in search.search_tool(frame, q).select("url", "score", "snippet").collect()]
        assert rows(index.matching(q.lower().split())) == rows(a)
    found = index.matching(["quasarling"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [_part#") >= 2
    read = 0
    for at in index.segments():
        parts = [r["_doc"] // 64 for r in index.candidates(at, ["quasarling"]).collect()]
        read += spark.read.schema("_part long").parquet(f"{at}/articles").filter(F.col("_part").isin(parts)).count()
    assert found.count() <= read < 1000


def slow_pairs(spark, names, least):
    v = {}
    for r in canon.tfidf(names).collect():
        v.setdefault(r["name"], {})[r["gram"]] = r["weight"]
    words = lambda n: {w for w in n.lower().split() if len(w) > 2}
    digits = lambda n: "".join(c if c.isdigit() else " " for c in n).split()
    out = {}
    for a in v:
        for b in v:
            if a < b and digits(a) == digits(b) and (not words(a) or not words(b) or words(a) & words(b)):
                cosine = sum(w * v[b].get(g, 0.0) for g, w in v[a].items())
                if cosine >= least:
                    out[a, b] = round(cosine, 9)
    return out


def test_similar_names_with_a_gram_that_half_of_them_share(spark):
    rng = random.Random(8)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    names = {f"{rng.choice(stems)} {rng.choice(stems)}" + rng.choice([" zzqx", " zzqx", "", " 7", " inc"]) for _ in range(160)} | {"zzqx", "zzqx a", "a", "b c"}
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    want = slow_pairs(spark, frame, 0.7)
    assert len(want) > 10
    for block in (2000, 7):
        got = {(r["name"], r["other"]): round(r["cosine"], 9) for r in canon.similar_pairs(frame, 0.7, block).collect()}
        assert got == want


def test_blocks_of_a_shared_gram_are_even(spark):
    """Names of one word that all share their only grams but one: no key holds more than its blocks' rows."""
    names = spark.range(600).select(F.concat(F.lit("omnibus "), F.chr(F.col("id") % 26 + 97), F.chr(F.floor(F.col("id") / 26) + 97)).alias("name"))
    got = canon.similar_pairs(names, 0.9, 50)
    assert got.count() == len(slow_pairs(spark, names, 0.9))
