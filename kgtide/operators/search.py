"""News search over month-partitioned articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def in_months(a: DataFrame, first: str | None, last: str | None) -> DataFrame:
    if first:
        a = a.filter(F.col("month") >= first)
    return a.filter(F.col("month") <= last) if last else a


def query_terms(query: str, least: int = 3) -> list[str]:
    return [w for w in query.lower().split() if len(w) >= least]


def search(a: DataFrame, query: str, ticker: str | None = None, first: str | None = None, last: str | None = None, k: int = 8) -> DataFrame:
    """Title hits count twice, summary hits once; a short upper-case ticker filters,
    any other is one more keyword.  Without keywords the latest come first."""
    a, terms = in_months(a, first, last), query_terms(query)
    if ticker and ticker.isupper() and 2 <= len(ticker) <= 5:
        a = a.filter(F.col("ticker") == ticker)
    elif ticker:
        terms.append(ticker.lower())
    score = text.keyword_score([(F.col("title"), 2), (F.col("summary"), 1)], terms)
    scored = a.withColumn("score", score.cast("long"))
    if terms:
        scored = scored.filter("score > 0")
    return scored.orderBy(F.desc("score"), F.desc("date"), "url").limit(k)


def search_tool(a: DataFrame, query: str, first: str | None = None, last: str | None = None, k: int = 10) -> DataFrame:
    """The tool's scoring: title three times, text once, terms of any length."""
    terms = query.lower().split()
    score = text.keyword_score([(F.col("title"), 3), (F.col("text"), 1)], terms)
    hits = in_months(a, first, last).withColumn("score", score.cast("long")).filter("score > 0")
    return hits.withColumn("snippet", text.snippet(F.col("text"), terms)).orderBy(F.desc("score"), F.desc("date"), "url").limit(min(k, 25))


def entity_news(a: DataFrame, name: str, k: int = 10) -> DataFrame:
    n = F.lit(name.lower())
    hits = a.filter(F.contains(F.lower("title"), n) | F.contains(F.lower("text"), n))
    return hits.withColumn("snippet", text.snippet(F.col("text"), [name])).orderBy(F.desc("date"), "url").limit(min(k, 25))
