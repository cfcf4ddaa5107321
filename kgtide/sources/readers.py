"""Files in and out: triplet CSV, month partitions, feeds and tables of HTML."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions import text
from ..operators import graph

TRIPLET = "struct<sub:string,sub_type:string,rel:string,rel_category:string,obj:string,obj_type:string>"
ENRICHED = "struct<sub:string,sub_type:string,rel:string,rel_category:string,obj:string,obj_type:string,sentiment:double,materiality_usd:double,event_type:string>"
ARTICLE = "date string, title string, ticker string, url string, text string, summary string, output_triplets string"


_FIELD = r"(None|'[^'\\\n\r\0]*+(?:\\[\\'nr][^'\\\n\r\0]*+)*+')"
#: A tuple as ``tuples_literal`` writes it, and a list of such tuples.
_TUPLE = re.compile(r"\(" + ", ".join([_FIELD] * 6) + r"\)")
_TUPLES = re.compile(r"\[{0}(?:, {0})*+\]".format(_TUPLE.pattern.replace("(None", "(?:None")))


def _text(field: str) -> str | None:
    if field == "None":
        return None
    if "\\" not in field:
        return field[1:-1]
    return field[1:-1].replace("\\\\", "\0").replace("\\'", "'").replace("\\n", "\n").replace("\\r", "\r").replace("\0", "\\")


def literal_items(raw: str | None, strip: bool = False) -> list[tuple]:
    """The six-field items of a list literal; anything malformed gives none.

    Lists in the form that is written here are taken apart by a pattern, about eight
    times as fast as Python's parser, which reads every other form.
    """
    if raw and _TUPLES.fullmatch(trimmed := raw.strip()):
        items = [tuple([_text(v) for v in x]) for x in _TUPLE.findall(trimmed)]
        return [tuple(None if v is None else v.strip() for v in x) for x in items] if strip else items
    try:
        found = ast.literal_eval(re.sub(r"^```\w*\s*|\s*```$", "", raw.strip())) if raw else []
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return []
    if not isinstance(found, list):
        return []
    items = [x for x in found if isinstance(x, (tuple, list)) and len(x) == 6]
    return [tuple(None if v is None else str(v).strip() if strip else str(v) for v in x) for x in items]


NAMES = ("sub", "sub_type", "rel", "rel_category", "obj", "obj_type")


def _by_cell(parse: Callable[[str | None], list], returns: str) -> Callable[[Column], Column]:
    """A function of one cell as an Arrow function of columns."""

    @F.pandas_udf(returns)
    def run(cells: pd.Series) -> pd.Series:
        return cells.map(parse)

    return run


def parse_triplets(raw: Column, strip: bool = False) -> Column:
    """A list literal of 6-tuples, which JSON can't express, as structs; with
    ``strip`` every field is trimmed."""


    @F.arrow_udf(f"array<{TRIPLET}>")
    def run(cells: pa.Array) -> pa.Array:
        ends, flat = [0], []
        for cell in cells.to_pylist():
            flat += literal_items(cell, strip)
            ends.append(len(flat))
        columns = zip(*flat, strict=True) if flat else [()] * len(NAMES)
        structs = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=list(NAMES))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    return run(raw)


def _published(raw: str | None) -> list[dict]:
    default = {"sub_type": "UNK", "rel": "Related To", "rel_category": "UNK", "obj_type": "UNK"}
    items = [dict(zip(NAMES, ("None" if v is None else v for v in x), strict=True)) for x in literal_items(raw)]
    return [
        {k: v or default.get(k, v) for k, v in x.items()} | {"sentiment": 0.0, "materiality_usd": None, "event_type": "OTHER"}
        for x in items if x["sub"] and x["obj"] and x["sub"] != x["obj"]
    ]


def parse_published(raw: Column) -> Column:
    """6-tuples as enriched triplets with neutral defaults, without empty ends and self-loops."""
    return _by_cell(_published, f"array<{ENRICHED}>")(raw)


def _weighted(raw: str | None) -> list[dict]:
    """Triplets with their weight from a list literal of dicts or 6-tuples."""
    try:
        found = ast.literal_eval(raw.strip()) if raw else []
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return []
    out = []
    for x in found if isinstance(found, list) else []:
        if isinstance(x, dict) and x.get("sub") and x.get("obj"):
            out.append({k: str(x.get(k, "UNK")) for k in NAMES} | {"w": float(x.get("w") or 1)})
        elif isinstance(x, (tuple, list)) and len(x) == 6:
            out.append(dict(zip(NAMES, map(str, x), strict=True)) | {"w": 1.0})
    return out


def weighted_triplets(df: DataFrame, column: str = "output_triplets") -> DataFrame:
    """A row for each weighted triplet of a cell beside the other columns, cell by
    cell, so that a task holds the triplets of one cell."""
    keep = [c for c in df.columns if c != column]
    rows = df.select(*keep, column)
    out = StructType([*rows.schema[:-1], *(StructField(k, StringType()) for k in NAMES), StructField("w", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in enumerate(batch.column(len(keep))):
                found = _weighted(raw.as_py())
                if found:
                    own = [batch.column(j).take(pa.array([i] * len(found))) for j in range(len(keep))]
                    texts = [pa.array([x[k] for x in found], pa.string()) for k in NAMES]
                    yield pa.RecordBatch.from_arrays([*own, *texts, pa.array([x["w"] for x in found], pa.float64())], names=out.names)

    return rows.mapInArrow(run, out)


def literal(c: Column) -> Column:
    """A string as a Python literal, or None."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def tuples_literal(triplets: Column) -> Column:
    """An array of triplets as a list literal of 6-tuples."""
    one = lambda t: F.concat(F.lit("("), F.concat_ws(", ", *(literal(t[k]) for k in NAMES)), F.lit(")"))
    return F.concat(F.lit("["), F.array_join(F.transform(triplets, one), ", "), F.lit("]"))


def dicts_literal(triplets: Column) -> Column:
    """An array of triplets with a weight w as a list literal of dicts."""
    field = lambda k, v: F.concat(F.lit(f"'{k}': "), v)
    one = lambda t: F.concat(F.lit("{"), F.concat_ws(", ", *(field(k, literal(t[k])) for k in NAMES), field("w", t["w"].cast("double").cast("string"))), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(triplets, one), ", "), F.lit("]"))


def gated(revised: Column, first: Column, strict: bool = False) -> Column:
    """The revised list of triplets where it has some.  Otherwise the first list,
    with ``strict`` only where the verdict says that it meets the expectation."""
    r, f = parse_triplets(revised, True), parse_triplets(first, True)
    other = F.when(F.lower(F.coalesce(revised, F.lit(""))).contains("evaluation meets expectation"), f).otherwise(F.array().cast(f"array<{TRIPLET}>")) if strict else f
    return F.when(F.size(r) > 0, r).otherwise(other)


def enriched_items(raw: str | None) -> list[dict]:
    """Items with five texts; numbers that are none give neutral values."""
    m = re.search(r"(?s)\[.*\]", raw or "")
    try:
        found = json.loads(m[0]) if m else []
    except ValueError:
        return []
    number = lambda x: float(x) if isinstance(x, (int, float)) else None
    some = lambda x, other: x if isinstance(x, str) and x.strip() else other
    out = []
    for x in found:
        if isinstance(x, dict) and all(isinstance(x.get(k), str) for k in ("sub", "sub_type", "rel", "obj", "obj_type")):
            usd = number(x.get("materiality_usd"))
            own = {"rel_category": some(x.get("rel_category"), "UNK"), "sentiment": number(x.get("sentiment")) or 0.0, "materiality_usd": usd if usd and usd > 0 else None, "event_type": some(x.get("event_type"), "OTHER")}
            out.append({k: x[k] for k in ("sub", "sub_type", "rel", "obj", "obj_type")} | own)
    return out


def parse_enriched(raw: Column) -> Column:
    """JSON between the first and last bracket of a reply, items without the
    five required strings dropped and numbers coerced."""
    return _by_cell(enriched_items, f"array<{ENRICHED}>")(raw)


def explode_triplets(df: DataFrame, column: str = "triplets") -> DataFrame:
    """One row for each triplet, with ``seq``, its place from 0."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.posexplode(column).alias("seq", "_t")).select(*keep, "seq", "_t.*")


def read_articles(spark: SparkSession, path: str, drop_malformed: bool = False, fill: bool = True) -> DataFrame:
    """Article CSV with quoted line breaks; with ``fill`` nulls become empty strings."""
    mode = "DROPMALFORMED" if drop_malformed else "PERMISSIVE"
    rows = spark.read.schema(ARTICLE).option("header", True).option("multiLine", True).option("escape", '"').option("mode", mode).csv(path)
    return rows.na.fill("") if fill else rows


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV lines of the schema; a line with more or fewer cells is left out."""
    kept = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    return kept.filter("_bad is null").drop("_bad")


def csv_edges(spark: SparkSession, path: str) -> DataFrame:
    """Monthly edges of an article CSV: unreadable dates and missing cells go,
    malformed lists are empty, and ends and relations are normalised."""
    rows = with_month(read_articles(spark, path, fill=False)).select("month", "url", parse_triplets(F.col("output_triplets")).alias("triplets"))
    return graph.month_edges(graph.clean(explode_triplets(rows)))


def with_month(df: DataFrame, date: str = "date", needed: str = "output_triplets") -> DataFrame:
    """Rows with a readable date and the needed column, with their month."""
    at = F.coalesce(*(F.try_to_timestamp(F.col(date), F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss[XXX]", "yyyy-MM-dd")))
    return df.withColumn("_at", at).filter(F.col("_at").isNotNull() & F.col(needed).isNotNull()).withColumn("month", F.date_format("_at", "yyyy-MM")).drop("_at")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}")
    return df


def slice_dates(df: DataFrame, first: str, last: str, date: str = "date") -> DataFrame:
    return df.filter(F.substring(date, 1, 10).between(first, last))


def read_months(spark: SparkSession, path: str, schema: str | None = None, last: int | None = None) -> DataFrame:
    """Month partitions, or the last N that exist (gaps don't count)."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    if last is None:
        return df
    months = df.select("month").distinct().orderBy(F.desc("month")).limit(last)
    return df.join(F.broadcast(months), "month", "left_semi")  # at most `last` rows


def write_months(df: DataFrame, path: str) -> None:
    """Replaces the months of ``df`` and leaves others: rerunning changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_month(spark: SparkSession, path: str, month: str, schema: str) -> DataFrame:
    """One month's partition; none where it, or the whole table, is missing."""
    if not exists(spark, f"{path}/month={month}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("month") == month)


def read_month_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents by month; the month is that of the file's or folder's name."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("month", F.regexp_extract(F.input_file_name(), r"([0-9]{4}-[0-9]{2})(?:\.json$|/[^/]*$)", 1))


_ITEM = r"(?s)<item[ >](.*?)</item>"


def _plain(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?s)^\s*(?:<!\[CDATA\[)?|(?:\]\]>)?\s*$", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _tag(c: Column, tag: str) -> Column:
    return _plain(F.regexp_extract(c, rf"(?s)<{tag}(?: [^>]*)?>(.*?)</{tag}>", 1))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed documents as they were fetched, a file each: path, xml."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("xml"))


def is_feed(xml: Column) -> Column:
    """Whether a document is a whole feed: closed, and as many items begun as ended."""
    count = lambda mark: F.regexp_count(xml, F.lit(mark))
    return F.coalesce(F.contains(xml, F.lit("</rss>")) & (count("<item[ >]") == count("</item>")), F.lit(False))


def rss_items(raw: DataFrame, today: Column, limit: int = 25, xml: str = "xml", news: bool = False) -> DataFrame:
    """Items of the whole feeds, at most ``limit`` of each: ord, title, url, source, date, text.

    A broken feed gives none and does not hinder others; see ``broken_feeds``.
    ``news``: items name their own source; otherwise the feed's title is it.
    """
    keep = [c for c in raw.columns if c != xml]
    items = F.slice(F.regexp_extract_all(F.col(xml), F.lit(_ITEM), 1), 1, limit)
    title = F.regexp_extract(xml, r"(?s)^(.*?)(?:<item[ >]|$)", 1)
    rows = raw.filter(is_feed(F.col(xml))).select(*keep, _tag(title, "title").alias("_feed"), F.posexplode(items).alias("ord", "_item"))
    i = F.col("_item")
    own, named = _tag(i, "source"), F.when(F.col("_feed") == "", "rss").otherwise(F.col("_feed"))
    source = F.when(own == "", "google_news").otherwise(F.concat(F.lit("google_news:"), own)) if news else named
    body = _tag(i, "description")
    return rows.select(
        *keep, "ord", _tag(i, "title").alias("title"), _tag(i, "link").alias("url"), source.alias("source"),
        text.rss_date(_tag(i, "pubDate"), today).alias("date"), F.when(body == "", _tag(i, "title")).otherwise(body).alias("text"),
    )


def broken_feeds(raw: DataFrame, xml: str = "xml") -> DataFrame:
    return raw.filter(~is_feed(F.col(xml))).drop(xml)


def fetch_plan(spark: SparkSession, watchlist: str) -> DataFrame:
    """The fetches of a YAML watchlist: source, item, terms, region, lang, url.

    Tickers for each source, feeds for rss_feeds, further queries for google_news;
    a source that is not known is left out.
    """
    import yaml

    w = yaml.safe_load(watchlist) or {}
    extra = w.get("extra_google_queries") or {}
    rows = []
    for source in w.get("sources") or []:
        if source == "rss_feeds":
            rows += [(source, feed, None, None, None) for feed in w.get("rss_feeds") or []]
        elif source in ("google_news", "yahoo_finance"):
            rows += [(source, str(t), "stock", "US", "en") for t in w.get("tickers") or []]
        if source == "google_news":
            rows += [(source, str(t), "", extra.get("region", "US"), extra.get("lang", "en")) for t in extra.get("terms") or []]
    plan = spark.createDataFrame(rows, "source string, item string, terms string, region string, lang string")
    query = text.url_quote(F.trim(F.concat("item", F.lit(" "), "terms")))
    google = F.format_string("https://news.google.com/rss/search?q=%s&hl=%s&gl=%s&ceid=%s:%s", query, "lang", "region", "region", "lang")
    return plan.withColumn("url", F.when(F.col("source") == "google_news", google).when(F.col("source") == "rss_feeds", F.col("item")))


def watchlist_rows(table: DataFrame) -> DataFrame:
    """Constituents with both ticker and country, ticker-like, each ticker once,
    with their exchange's suffix."""
    t = table.select(F.trim("Ticker").alias("ticker"), F.trim("Company").alias("company"), F.trim("Country").alias("country")).filter("ticker <> '' and country <> ''")
    t = t.filter(F.col("ticker").rlike(r"^[A-Z0-9.\-]{1,15}$")).groupBy("ticker").agg(F.min(F.struct("country", "company")).alias("x"))
    return t.select("ticker", "x.company", "x.country", text.yahoo_ticker(F.col("ticker"), F.col("x.country")).alias("yahoo"))


def watchlist_lines(rows: DataFrame) -> DataFrame:
    """YAML lines by country and ticker, with a heading where the country changes: ord, line."""
    first = rows.groupBy("country").agg(F.min("yahoo").alias("_first"))
    item = F.concat(F.lit("  - "), F.rpad("yahoo", 12, " "), F.lit("  # "), F.col("company"))
    head = F.when(F.col("yahoo") == F.col("_first"), F.concat(F.lit("  # -- "), F.col("country"), F.lit(" --")))
    lines = rows.join(first, "country").select("country", "yahoo", F.posexplode(F.array_compact(F.array(head, item))).alias("_at", "line"))
    return graph.positions(lines, "country", "yahoo", "_at").select(F.col("pos").alias("ord"), "line")


def html_table(raw: DataFrame, wanted: list[str], html: str = "html") -> DataFrame:
    """Rows of the first table in a page whose header has the wanted columns, as maps."""

    @F.pandas_udf("array<map<string,string>>")
    def rows(pages: pd.Series) -> pd.Series:
        plain = lambda s: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", s)).strip()

        def first(page: str | None) -> list[dict]:
            for block in re.findall(r"(?is)<table.*?</table>", page or ""):
                lines = [[plain(c) for c in re.findall(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>", r)] for r in re.findall(r"(?is)<tr.*?</tr>", block)]
                if lines and set(wanted) <= set(lines[0]):
                    return [dict(zip(lines[0], r, strict=False)) for r in lines[1:]]
            return []

        return pages.map(first)

    return raw.select(F.explode(rows(html)).alias("r")).select(*(F.element_at("r", c).alias(c) for c in wanted))


def upsert_variants(index: DataFrame, fresh: DataFrame, front: bool = False) -> DataFrame:
    """Rows of ``index`` (id, ord, …) with those of ``fresh`` in place or added."""
    old = index.join(fresh.select("id"), "id", "left_anti")
    placed = fresh.drop("ord").join(index.select("id", "ord"), "id", "left")
    if front:
        placed = placed.withColumn("ord", F.lit(-1))
    out = old.unionByName(placed.withColumn("ord", F.coalesce("ord", F.lit(1 << 30))), allowMissingColumns=True)
    return out.withColumn("ord", F.row_number().over(Window.orderBy("ord", "id")) - 1)  # an index of a few models


def add_feature(catalog: DataFrame, source: str, feature: str) -> DataFrame:
    return catalog.withColumn("features", F.when(F.col("id") == source, F.array_union("features", F.array(F.lit(feature)))).otherwise(F.col("features")))


def listed_sources(catalog: DataFrame) -> DataFrame:
    """Sources that are available and are no report."""
    return catalog.filter("available and kind <> 'report'")
