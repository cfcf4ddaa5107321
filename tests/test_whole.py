"""Queries do the whole job."""

from test_oracle import duck, rows  # noqa: F401  duck is a fixture

from kgtide import catalog
from kgtide.operators import ml, search
from kgtide.plans.graphs import edges
from kgtide.sources import adapter


def agrees(spark, sf_dir, duck, name):  # noqa: F811
    ours = catalog.queries()[name](spark, sf_dir).toPandas()
    assert rows(ours) == rows(duck.execute(catalog.oracle_sql()[name]).df())
    return ours


def test_gat_input_packs_every_month(spark, sf_dir, duck):  # noqa: F811
    ours = agrees(spark, sf_dir, duck, "gat_input")
    months = duck.execute("SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem").fetchall()
    assert sorted(ours["month"]) == sorted(m for (m,) in months)


def test_links_hold_every_customer(spark, sf_dir, duck):  # noqa: F811
    ours = agrees(spark, sf_dir, duck, "graph_components")
    customers = duck.execute("SELECT DISTINCT 'c' || c_custkey FROM customer").fetchall()
    assert sorted(n for n in ours["node"] if n[0] == "c") == sorted(c for (c,) in customers)


def test_news_is_searched_in_the_whole_text(spark, sf_dir, duck):  # noqa: F811
    news = [("u1", "a title", "x " * 400 + "Rare thing", "2020-01-01", "2020-01"), ("u2", "a title", "x", "2020-01-02", "2020-01")]
    news = spark.createDataFrame(news, "url string, title string, text string, date string, month string").selectExpr("*", "substring(text, 1, 600) AS summary")
    for hits in (search.search_tool(news, "rare"), search.entity_news(news, "Rare")):
        assert [(r["url"], "Rare thing" in r["snippet"]) for r in hits.collect()] == [("u1", True)]
    texts = dict(duck.execute("SELECT 'doc://' || doc_id, text FROM documents").fetchall())
    assert {r["url"]: r["text"] for r in adapter.articles(spark, sf_dir).collect()} == texts


def test_layout_places_every_month_in_120_steps(spark, sf_dir, duck):  # noqa: F811
    ours = catalog.queries()["graph_layout"](spark, sf_dir).toPandas()
    months = duck.execute("SELECT DISTINCT strftime(l_shipdate, '%Y-%m') FROM lineitem").fetchall()
    assert set(ours["month"]) == {m for (m,) in months}
    last = ours["month"].max()
    steps = ml.spring_layout(edges(spark, sf_dir).filter(f"month = '{last}'"), 120).toPandas()
    assert rows(ours[ours["month"] == last]) == rows(steps)


def test_cooccurrence_holds_200_entities(spark, sf_dir, duck):  # noqa: F811
    ours = agrees(spark, sf_dir, duck, "cooccurrence_daily")
    assert ours["entity"].nunique() > 30
