"""Queries on names, triplet cells and generated replies."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vocab
from ..operators import canon, generate, graph, naming
from ..operators.lineage import broadcast_if_small, cut
from ..sources import readers
from ..sources.adapter import NAMES_SQL, TRIPLETS_SQL, dirty_names, table, triplets
from .analytics import GRAMS, _key_sql
from .graphs import EDGES, edges
from .registry import query

W = f"WITH {TRIPLETS_SQL}"


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Decorated names with frequencies and types."""
    return dirty_names(spark, d).withColumn("type", F.when(F.length("name") % 3 == 0, "PRODUCT").otherwise("COMPANY"))


TYPED_NAMES = f"{NAMES_SQL}, typed AS (SELECT *, CASE WHEN length(name) % 3 = 0 THEN 'PRODUCT' ELSE 'COMPANY' END AS type FROM names)"
_RANKED = " OR ".join(f"regexp_matches(trim(n), '{p}')" for p in vocab.RANKED_JUNK_PATTERNS)
_LISTED = ", ".join(f"'{x}'" for x in vocab.RANKED_JUNK_NAMES)


@query(f"""WITH {NAMES_SQL} SELECT name, trim(n) = '' OR n IN ({_LISTED}) OR {_RANKED} AS junk FROM (SELECT name, lower(name) AS n FROM names)
UNION ALL SELECT 'Zacks Rank ' || n_nationkey, true FROM nation UNION ALL SELECT ' Price Target', false UNION ALL SELECT 'PRICE target', true UNION ALL SELECT '52-week Highs', true UNION ALL SELECT 'Week High', false""")
def canon_ranked_junk(spark, d):
    """Names that are not ranked; the list is looked up before trimming."""
    more = table(spark, d, "nation").select(F.concat(F.lit("Zacks Rank "), F.col("n_nationkey").cast("string")).alias("name"))
    odd = spark.createDataFrame([(" Price Target",), ("PRICE target",), ("52-week Highs",), ("Week High",)], "name string")
    names = dirty_names(spark, d).select("name").unionByName(more).unionByName(odd)
    return names.select("name", text.is_ranked_junk(F.col("name")).alias("junk"))


SYMBOL = """CASE s_suppkey % 6 WHEN 0 THEN 'LSE:T' || s_suppkey WHEN 1 THEN 'T' || s_suppkey || '.L' WHEN 2 THEN 'T' || s_suppkey WHEN 3 THEN 'T' || s_suppkey || ':NASDAQ' WHEN 4 THEN 'T ' || s_suppkey ELSE 't' || s_suppkey END"""


def _symbol(k: Column) -> Column:
    """A supplier's symbol with one of the decorations."""
    t = F.concat(F.lit("T"), k.cast("string"))
    return F.when(k % 6 == 0, F.concat(F.lit("LSE:"), t)).when(k % 6 == 1, F.concat(t, F.lit(".L"))).when(k % 6 == 2, t).when(k % 6 == 3, F.concat(t, F.lit(":NASDAQ"))).when(k % 6 == 4, F.concat(F.lit("T "), k.cast("string"))).otherwise(F.lower(t))


def _companies(s: DataFrame) -> DataFrame:
    return s.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string"), F.lit(".L")).alias("ticker"), F.col("s_name").alias("company"))


@query(f"""SELECT {SYMBOL} AS name, s_name AS canonical FROM supplier
WHERE s_suppkey % 6 < 5 AND (s_suppkey % 6 = 1 OR length('T' || s_suppkey) >= 3 OR s_nationkey % 2 = 0)""")
def canon_ticker_aliases(spark, d):
    """Decorated symbols to their companies."""
    s = table(spark, d, "supplier")
    names = s.select(_symbol(F.col("s_suppkey")).alias("name"), F.when(F.col("s_nationkey") % 2 == 0, "STOCK_TICKER").otherwise("COMPANY").alias("type"))
    return naming.ticker_aliases(names, _companies(s))


SUFFIXED = f"""k AS (SELECT *, {_key_sql("name")} AS key FROM typed),
a AS (SELECT *, max((lower(trim(name)) <> key)::INT) OVER (PARTITION BY key) AS away, min(starts_with(lower(trim(name)), key)::INT) OVER (PARTITION BY key) AS begins FROM k WHERE length(key) >= 2),
m AS (SELECT name, first_value(name) OVER (PARTITION BY key, CASE WHEN away = 0 THEN type ELSE '' END ORDER BY freq DESC, name) AS canonical FROM a WHERE length(key) > 2 OR (away = 1 AND begins = 1)),
suffixed AS (SELECT * FROM m WHERE name <> canonical)"""


@query(f"WITH {TYPED_NAMES}, {SUFFIXED} SELECT * FROM suffixed")
def canon_suffix_types(spark, d):
    """Names merged by suffix keys, within a type where no ending tells them alike."""
    return naming.suffix_merge(_names(spark, d))


@query("""WITH b AS (SELECT DISTINCT p_name AS base FROM part), s AS (SELECT base || CASE length(base) % 2 WHEN 0 THEN ' Shares' ELSE ' stock' END AS name, base FROM b)
SELECT name, CASE WHEN length(base) % 3 = 0 THEN 'X ' || base ELSE base END AS canonical FROM s UNION ALL SELECT base, 'X ' || base FROM b WHERE length(base) % 3 = 0""")
def canon_shares(spark, d):
    """"X Shares" into what X is merged into."""
    b = table(spark, d, "part").select(F.col("p_name").alias("base")).distinct()
    shares = b.select(F.concat("base", F.when(F.length("base") % 2 == 0, " Shares").otherwise(" stock")).alias("name"))
    mapping = b.filter(F.length("base") % 3 == 0).select(F.col("base").alias("name"), F.concat(F.lit("X "), "base").alias("canonical"))
    return naming.shares_merge(b.select(F.col("base").alias("name")).unionByName(shares), mapping)


LIKE = f"""{GRAMS}, words AS (SELECT name, list_filter(string_split_regex(lower(name), '\\s+'), lambda x: length(x) > 2) AS words, regexp_extract_all(name, '\\d+') AS digits, type FROM typed),
alike AS (SELECT a.name, b.name AS other FROM v a JOIN v b ON a.gram = b.gram AND a.name < b.name GROUP BY ALL HAVING sum(a.v * b.v) >= 0.8),
pairs AS (SELECT alike.name, other FROM alike JOIN words a ON a.name = alike.name JOIN words b ON b.name = other
  WHERE a.type = b.type AND a.digits = b.digits AND (len(a.words) = 0 OR len(b.words) = 0 OR list_has_any(a.words, b.words))),
ends AS (SELECT name AS a, other AS b FROM pairs UNION SELECT other, name FROM pairs),
reach AS (SELECT a, b FROM ends UNION SELECT reach.a, ends.b FROM reach JOIN ends ON reach.b = ends.a),
parts AS (SELECT a AS name, least(min(b), a) AS root FROM reach GROUP BY a),
best AS (SELECT root, arg_min(name, (-freq, -length(name), name)) AS canonical FROM parts JOIN typed USING (name) GROUP BY root)"""


@query(f"WITH RECURSIVE {TYPED_NAMES}, {LIKE} SELECT name, canonical FROM parts JOIN best USING (root) WHERE name <> canonical")
def canon_entity_map(spark, d):
    """Names of one type that are alike, directly or through others, to one of them."""
    return naming.likeness_merge(_names(spark, d))


_JUNK = f"length(n) < 2 OR n IN ({', '.join(f"'{x}'" for x in vocab.JUNK_NAMES)}) OR {' OR '.join(f"regexp_matches(n, '{p}')" for p in vocab.JUNK_PATTERNS)}"
_LIKE_LATER = LIKE.replace("FROM names", "FROM third").replace("FROM typed", "FROM third").replace("JOIN typed", "JOIN third").replace("0.8", "0.9")


@query(f"""WITH RECURSIVE {TYPED_NAMES},
firms AS (SELECT s_suppkey AS k, s_name AS firm, {SYMBOL} AS symbol, s_nationkey % 2 = 0 AS listed FROM supplier),
every AS (SELECT * FROM typed UNION ALL SELECT symbol, k % 7 + 1, CASE WHEN listed THEN 'STOCK_TICKER' ELSE 'COMPANY' END FROM firms
  UNION ALL SELECT firm || CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' Shares' ELSE ' stock' END, k % 5 + 1, 'COMPANY' FROM firms UNION ALL SELECT upper(firm), 1, 'COMPANY' FROM firms WHERE k % 3 = 0),
kept AS (SELECT name, freq, type FROM (SELECT *, lower(trim(name)) AS n FROM every) WHERE NOT ({_JUNK})),
tickers AS (SELECT symbol AS name, firm AS canonical FROM firms WHERE k % 6 < 5 AND (k % 6 = 1 OR length('T' || k) >= 3 OR listed)),
moved AS (SELECT coalesce(canonical, name) AS name, sum(freq) AS freq FROM kept LEFT JOIN tickers USING (name) GROUP BY 1),
second AS (SELECT name, moved.freq, coalesce(type, 'UNK') AS type FROM moved LEFT JOIN kept USING (name)),
{SUFFIXED.replace("FROM typed", "FROM second")},
bases AS (SELECT name, lower(regexp_extract(trim(name), '^(.+?)\\s+(shares?|stock)$', 1, 'i')) AS base FROM second ANTI JOIN suffixed USING (name)),
known AS (SELECT lower(trim(name)) AS base, max(name) AS onto FROM second GROUP BY 1),
steps AS (SELECT name, canonical FROM suffixed UNION ALL SELECT bases.name, coalesce(s.canonical, onto) FROM bases JOIN known USING (base) LEFT JOIN suffixed s ON s.name = onto WHERE base <> '' AND bases.name <> onto),
again AS (SELECT coalesce(canonical, name) AS name, sum(freq) AS freq FROM second LEFT JOIN steps USING (name) GROUP BY 1),
third AS (SELECT name, again.freq, coalesce(type, 'UNK') AS type FROM again LEFT JOIN second USING (name)), {_LIKE_LATER},
alike_to AS (SELECT name, canonical FROM parts JOIN best USING (root) WHERE name <> canonical),
one AS (SELECT kept.name, coalesce(t.canonical, kept.name) AS a FROM kept LEFT JOIN tickers t USING (name)),
two AS (SELECT one.name, coalesce(s.canonical, a) AS a FROM one LEFT JOIN steps s ON s.name = a),
three AS (SELECT two.name, coalesce(l.canonical, a) AS a FROM two LEFT JOIN alike_to l ON l.name = a)
SELECT name, a AS canonical FROM three WHERE name <> a""")
def canon_clean_map(spark, d):
    """Symbols, legal endings, shares and likeness in turn, frequencies counted again between."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    symbol, company = _symbol(k), F.lit("COMPANY")
    ending = F.when(k % 4 == 0, "").when(k % 4 == 1, " Inc.").when(k % 4 == 2, " Shares").otherwise(" stock")
    every = (
        _names(spark, d).select("name", "freq", "type")
        .unionByName(s.select(symbol.alias("name"), (k % 7 + 1).alias("freq"), F.when(F.col("s_nationkey") % 2 == 0, "STOCK_TICKER").otherwise("COMPANY").alias("type")))
        .unionByName(s.select(F.concat("s_name", ending).alias("name"), (k % 5 + 1).alias("freq"), company.alias("type")))
        .unionByName(s.filter(k % 3 == 0).select(F.upper("s_name").alias("name"), F.lit(1).alias("freq"), company.alias("type")))
    )
    return naming.clean_map(every, _companies(s))


@query(f"""{EDGES}, m AS (SELECT "month", sub, upper(rel) AS rel, CASE WHEN obj = 'Brand#55' THEN 'Revenue' ELSE substring(obj, 1, 7) END AS obj, weight FROM edges),
x AS (SELECT "month", CASE WHEN sub LIKE '%1' THEN 'Brand#1' ELSE sub END AS sub, rel, obj, weight FROM m)
SELECT "month", sub, rel, obj, sum(weight)::BIGINT AS weight FROM x WHERE obj <> 'Revenue' AND sub <> obj GROUP BY ALL""")
def canon_rename_merge(spark, d):
    """Edges renamed by maps; junk ends and self-loops go, equal ones add up."""
    t, e = triplets(spark, d, False), edges(spark, d)
    names = lambda c: t.select(F.col(c).alias("name")).distinct()
    brands = names("obj").withColumn("canonical", F.when(F.col("name") == "Brand#55", "Revenue").otherwise(F.substring("name", 1, 7)))
    firms = names("sub").filter(F.col("name").endswith("1")).withColumn("canonical", F.lit("Brand#1"))
    rels = names("rel").withColumn("canonical", F.upper("name"))
    # Few names stand at many edges: joined by a shuffle, a name's edges would be in one task.
    brands, firms, rels = (broadcast_if_small(cut(m), 1_000_000) for m in (brands, firms, rels))
    return graph.clean_merge(canon.rename(canon.rename(canon.rename(e, brands, "obj"), firms, "sub"), rels, "rel"))


@query(f"""{W}, x AS (SELECT sub AS name, sub_type AS type FROM triplets UNION ALL SELECT obj, obj_type FROM triplets), c AS (SELECT name, type, count(*) AS n FROM x GROUP BY ALL)
SELECT name, sum(n)::BIGINT AS freq, arg_min(type, (-n, type)) AS type FROM c GROUP BY name""")
def canon_frequency(spark, d):
    """How often a name stands at an end, and its commonest type."""
    return naming.frequency(triplets(spark, d, False))


@query(f"""{EDGES}, n AS (SELECT "month", node, sum(weight) AS degree FROM (SELECT "month", sub AS node, weight FROM edges UNION ALL SELECT "month", obj, weight FROM edges) GROUP BY ALL)
SELECT node AS name, sum(greatest(1, degree))::BIGINT AS freq FROM n GROUP BY node""")
def canon_degree_frequency(spark, d):
    return naming.degree_frequency(graph.weighted_degree(edges(spark, d), "month"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a first and a revised cell of triplets."""
    key = F.col("o_orderkey")
    cust = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    one = lambda rel, obj: F.concat(F.lit("[('"), cust, F.lit(f"', 'COMPANY', '{rel}', '', '"), obj, F.lit("', '')]"))
    revised = F.when(key % 4 == 0, one("Revised ", F.lit("o"))).when(key % 4 == 1, "Evaluation Meets Expectation.").when(key % 4 == 2, "Require Human Review")
    first = F.when(key % 6 == 0, one("", cust)).when(key % 6 == 1, one("Loops", F.lit(""))).otherwise(one("", F.col("o_orderpriority")))
    return table(spark, d, "orders").select(key.alias("id"), first.alias("first"), revised.alias("revised"))


@query("""SELECT o_orderkey AS id, 0::INT AS seq, CASE WHEN o_orderkey % 7 = 0 THEN ' C' ELSE 'C' END || o_custkey AS sub, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority ELSE 'it''s ' || o_orderpriority END AS obj, NULL::VARCHAR AS obj_type FROM orders WHERE o_orderkey % 5 < 3
UNION ALL SELECT o_orderkey, 1, '7', 'b', 'None' FROM orders WHERE o_orderkey % 5 = 2""")
def pf_sanitised(spark, d):
    """Lists of 6-tuples out of replies with fences; other items and malformed lists go."""
    key = F.col("o_orderkey")
    sub = F.concat(F.when(key % 7 == 0, " C").otherwise("C"), F.col("o_custkey").cast("string"))
    obj = F.when(key % 2 == 1, F.concat(F.lit("'"), "o_orderpriority", F.lit("'"))).otherwise(F.concat(F.lit('"it\'s '), "o_orderpriority", F.lit('"')))
    six = F.concat(F.lit("('"), sub, F.lit("', 'COMPANY', 'r', '', "), obj, F.lit(", None)"))
    whole = F.concat(F.lit("[('a', 'b'), 3, "), six, F.lit("]"))
    raw = F.when(key % 5 == 0, whole).when(key % 5 == 1, F.concat(F.lit("```python\n"), whole, F.lit("\n```")))
    raw = raw.when(key % 5 == 2, F.concat(F.lit(" ```\n["), six, F.lit(", [7, 'x', 'r', 0.5, 'b', 'None']]```"))).when(key % 5 == 3, F.concat(F.lit("Here: "), whole))
    rows = table(spark, d, "orders").select(key.alias("id"), readers.parse_triplets(raw).alias("triplets"))
    return readers.explode_triplets(rows).select("id", "seq", "sub", "obj", "obj_type")


@query("""SELECT o_orderkey AS id, 'C' || o_custkey AS sub, 'Related To' AS rel, 'UNK' AS rel_category, o_orderpriority AS obj, 'UNK' AS obj_type, 0.0::DOUBLE AS sentiment, 'OTHER' AS event_type FROM orders WHERE o_orderkey % 6 > 1""")
def pf_published(spark, d):
    """6-tuples with neutral defaults, without empty ends and self-loops."""
    rows = _cells(spark, d).select("id", readers.parse_published(F.col("first")).alias("triplets"))
    return readers.explode_triplets(rows).select("id", "sub", "rel", "rel_category", "obj", "obj_type", "sentiment", "event_type")


FIRST = "CASE WHEN o_orderkey % 6 = 1 THEN 'Loops' ELSE '' END"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'Revised' ELSE {FIRST} END AS open, CASE WHEN o_orderkey % 4 = 0 THEN 'Revised' WHEN o_orderkey % 4 = 1 THEN {FIRST} END AS strict FROM orders""")
def pf_gating(spark, d):
    """Revised triplets, else the first ones; strictly only where the verdict allows."""
    rel = lambda strict: F.get(readers.gated(F.col("revised"), F.col("first"), strict), F.lit(0))["rel"]
    return _cells(spark, d).select("id", rel(False).alias("open"), rel(True).alias("strict"))


def _reply(key: Column, number: Column) -> Column:
    """Replies around a JSON list, some of whose items lack what is needed."""
    good = F.format_string('{"sub": "S%s", "sub_type": "COMPANY", "rel": "Buys", "obj": "", "obj_type": "X", "sentiment": %s, "materiality_usd": %s, "event_type": " "}', key.cast("string"), F.when(key % 3 == 0, '"high"').otherwise("0.5"), number.cast("string"))
    listed = F.concat(F.lit('Sure:\n```json\n[{"sub": 7, "sub_type": "", "rel": "", "obj": "", "obj_type": ""}, "x", '), good, F.lit("]\n```"))
    return F.when(key % 5 == 0, "no list").when(key % 5 == 1, "[{]").when(key % 5 == 2, F.lit(None)).otherwise(listed)


@query("""SELECT event_id, 'S' || event_id AS sub, 'UNK' AS rel_category, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS sentiment, CASE WHEN user_id > 0 THEN user_id::DOUBLE END AS materiality_usd, 'OTHER' AS event_type
FROM events WHERE event_id % 5 > 2""")
def pf_enriched(spark, d):
    """Items of JSON replies with their five texts; other fields fall back."""
    e = table(spark, d, "events").select("event_id", readers.parse_enriched(_reply(F.col("event_id"), F.col("user_id"))).alias("triplets"))
    return readers.explode_triplets(e).select("event_id", "sub", "rel_category", "sentiment", "materiality_usd", "event_type")


def _stub(prompt: str) -> str:
    """A generator for queries and tests: it names the first word, and fails for some."""
    word = prompt.split()[1] if len(prompt.split()) > 1 else ""
    if word.startswith(("a", "e")):
        raise RuntimeError("no reply")
    return f'```json\n[{{"sub": "{word[:1]}", "sub_type": "COMPANY", "rel": "Says", "obj": "{len(prompt) % 7}", "obj_type": "CONCEPT"}}]\n```' if word.isalnum() and word.isascii() else "[]"


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^\s*(\S+)', 1) AS w FROM documents)
SELECT doc_id, substring(w, 1, 1) AS sub, ((length(text) + 3) % 7)::VARCHAR AS obj FROM d WHERE regexp_full_match(w, '[A-Za-z0-9]+') AND NOT starts_with(w, 'a') AND NOT starts_with(w, 'e')""")
def ud_extract(spark, d):
    """Triplets of documents by an injected generator, which fails for some."""
    a = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    found = generate.extract(a, "do {input_text_}", _stub, pause=0)
    return readers.explode_triplets(found.select("doc_id", "triplets")).select("doc_id", "sub", "obj")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^\s*(\S+)', 1) AS w FROM documents)
SELECT doc_id, 0 AS seq, substring(w, 1, 1) AS sub, 'Says' AS rel, ((length(text) + 3) % 7)::VARCHAR AS obj, 0.0::DOUBLE AS sentiment, NULL AS error FROM d WHERE regexp_full_match(w, '[A-Za-z0-9]+') AND NOT starts_with(w, 'a') AND NOT starts_with(w, 'e')
UNION ALL SELECT doc_id, -1, NULL, NULL, NULL, NULL, 'RuntimeError: no reply' FROM d WHERE starts_with(w, 'a') OR starts_with(w, 'e')""")
def ud_extract_lateral(spark, d):
    """The same by a table function in SQL, with failures as rows."""
    spark.udtf.register("extract_triplets", generate.extract_table(_stub, "do {input_text_}", pause=0))
    table(spark, d, "documents").createOrReplaceTempView("documents_to_extract")
    return spark.sql("SELECT doc_id, coalesce(seq, -1) AS seq, sub, rel, obj, sentiment, error FROM documents_to_extract, LATERAL extract_triplets(CAST(NULL AS STRING), text)")


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^\s*(\S+)', 1) AS w FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN NULL WHEN starts_with(w, 'a') OR starts_with(w, 'e') THEN 'kept' WHEN regexp_full_match(w, '[A-Za-z0-9]+') THEN substring(w, 1, 1) END AS sub FROM d""")
def ud_refine(spark, d):
    """Triplets judged once more: a failed call keeps them, an empty answer drops them."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    one = readers.parse_enriched(F.lit('[{"sub": "kept", "sub_type": "", "rel": "r", "obj": "o", "obj_type": ""}]'))
    a = docs.withColumn("triplets", one).withColumn("triplets", F.when(F.col("doc_id") % 2 == 1, F.slice("triplets", 1, 0)).otherwise(F.col("triplets")))
    return generate.refine(a, "do {input_text_}", _stub).select("doc_id", F.get("triplets", F.lit(0))["sub"].alias("sub"))


@query(f"""{W}, m AS (SELECT url, seq, CASE sub WHEN 'Supplier#000000003' THEN 'Supplier#000000004' WHEN 'Supplier#000000005' THEN 'Brand#11' ELSE sub END AS sub, obj FROM triplets)
SELECT url, seq, sub, obj FROM m WHERE sub <> obj""")
def ud_canonicalise(spark, d):
    """Triplets renamed by one answer; those that become self-loops go."""
    answer = 'Here: {"Supplier#000000003": "Supplier#000000004", "Supplier#000000005": "Brand#11", "x": 7, "y": "y"}'
    return generate.canonicalise(triplets(spark, d, False), lambda names: answer, []).select("url", "seq", "sub", "obj")


@query("""SELECT CASE WHEN count(*) = 0 THEN '' ELSE 'Context from the graph the analyst is viewing:
- Month range: **2020-01** → **2020-03**
- Focused entity: **X**

Relevant articles:

' || string_agg('### ' || n_name || '
_2020-01-01 · T_
s
' || '
', '' ORDER BY n_nationkey) || '
---

Analyst question:
Why?' END AS prompt, array_to_string(list('u' || n_nationkey ORDER BY n_nationkey), '|') AS sources FROM nation""")
def ud_chat_prompt(spark, d):
    """The prompt of a chat with its articles, and its sources."""
    hits = table(spark, d, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("title"), F.lit("2020-01-01").alias("date"), F.lit("T").alias("ticker"), F.lit("s").alias("summary"), F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("url"))
    return generate.chat_prompt(hits, "Why?", "2020-01", "2020-03", "X").select("prompt", F.array_join("sources", "|").alias("sources"))


def _slow_stub(prompt: str) -> str:
    """A generator for a query: it is late for prompts of some lengths."""
    if len(prompt) % 499 == 0:
        time.sleep(60)
    return f'[{{"sub": "late", "sub_type": "X", "rel": "r", "obj": "{len(prompt)}", "obj_type": "X"}}]'


@query("""SELECT doc_id, length(coalesce(text, ''))::VARCHAR AS obj FROM documents WHERE length(coalesce(text, '')) % 499 <> 0""")
def ud_timeout(spark, d):
    """Replies that take over two seconds count as empty lists."""
    a = table(spark, d, "documents").select("doc_id", F.lit(None).cast("string").alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    found = generate.extract(a, "{input_text_}", generate.with_timeout(_slow_stub, 2.0), pause=0, at_once=16)
    return readers.explode_triplets(found.select("doc_id", "triplets")).select("doc_id", "obj")
