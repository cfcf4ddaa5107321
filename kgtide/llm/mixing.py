"""Mixing sources to target weights by Sainte-Laguë apportionment, in
DataFrame functions only.

A document is as large as it has words.  Sources weigh 1, 2, 3, repeating, in
the order of their names (null last), and share the corpus' whole size by
weight, none above ``most`` times its own.  The targets are turned into whole
blocks of ``block`` words by highest quotients target / (2k + 1), first among
sources and then, within a source, among its shards.  A shard is a stream of
documents in seeded order; its quota is taken as full passes and then a run of
blocks from a seeded start, around the end.

Only quotients near the boundary are listed: with N seats, S parties and total
T, a party with t votes has between t(N - S/2)/T - 1/2 and t(N + S/2)/T + 1/2
seats, so a few candidates for each party decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, broadcast_if_small, cut, ws_words

#: Between a word's last white space and the next word: pieces keep the space after them.
WORD_STARTS = r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"
MOST = 3
BLOCK = 16
#: Least words and documents of a shard, about.  Shards grow as square roots of their
#: source, so that neither a shard nor the list of a source's shards gets large.
SHARD_WORDS, SHARD_DOCS = 400_000, 2_000


def ranked(rows: DataFrame, order: list[Column | str], **sums: Column) -> DataFrame:
    """Adds ``_rank``, the place from 1 in the order given, and for each of ``sums``
    the sum up to the row.

    Rows are dealt by ranges of the order and written; each range is then ranked
    by itself and moved on by what stands before it, so no task has all rows.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    per = dealt.groupBy("_range").agg(F.count("*").alias("_before"), *(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = per.select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_before", *(f"_{n}" for n in sums))))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    moved = dealt.join(F.broadcast(offsets), "_range").withColumn("_rank", F.col("_before") + F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return moved.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).drop("_range", "_before", *(f"_{n}" for n in sums))


def _candidates(sized: DataFrame, votes: str, seats: str) -> DataFrame:
    """Adds the seats that a party surely has and, one for each row of ``_k``, those it may have."""
    n, t = F.col("_parties") / 2, F.col(votes) / F.col("_total")
    some = F.col("_total") > 0
    sure = F.when(some, F.greatest(F.lit(0), F.floor(t * (F.col(seats) - n) - 0.5) - 1)).otherwise(0).cast("long")
    return sized.withColumns({"_sure": sure, "_most": F.when(some, F.floor(t * (F.col(seats) + n) + 0.5) + 1).otherwise(0).cast("long")})


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Adds ``quota``: ``seats`` (of the group) apportioned by highest quotients
    votes / (2k + 1); ties go by ``order``, which is unique within the group."""
    whole = Window.partitionBy(*group)
    sized = parties.withColumns({"_total": F.sum(votes).over(whole), "_parties": F.count("*").over(whole)})
    sized = _candidates(sized, votes, seats).withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    each = sized.filter(F.col(votes) > 0).withColumn("_k", F.explode(F.sequence("_sure", "_most")))
    rank = F.row_number().over(whole.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *order, "_k"))
    won = each.withColumn("_rank", rank).filter("_rank <= _open").groupBy(*group, *order).agg(F.count("*").alias("_won"))
    return sized.join(won, [*group, *order], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_total", "_parties", "_sure", "_most", "_open", "_won")


def apportion_all(parties: DataFrame, votes: str, seats: str, order: list[str]) -> DataFrame:
    """As ``apportion`` for one group of all ``parties`` (a written table), in many tasks."""
    one = parties.agg(F.sum(votes).alias("_total"), F.count("*").alias("_parties"))  # one row
    sized = cut(_candidates(parties.crossJoin(F.broadcast(one)), votes, seats), "parties")
    taken = sized.agg(F.sum("_sure").alias("_given"))  # one row
    each = sized.filter(F.col(votes) > 0).select(*order, seats, votes, F.explode(F.sequence("_sure", "_most")).alias("_k"))
    placed = ranked(each.withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1)), [F.desc("_quotient"), *order, "_k"])
    won = placed.crossJoin(F.broadcast(taken)).filter(F.col("_rank") <= F.col(seats) - F.col("_given")).groupBy(*order).agg(F.count("*").alias("_won"))
    return sized.join(won, order, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0))).drop("_total", "_parties", "_sure", "_most", "_won")


def _seeded(*parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def _key(docs: DataFrame, seed: int) -> Column:
    """A hash of a whole row, by which documents are dealt and ordered."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.to_json(F.struct(*(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(text), F.md5(rest)))


def mix(docs: DataFrame, seed: int = 7, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of
    ``docs`` (doc_id, source, text), with _key, a hash of the row, and the
    words taken: _passes times all, then from _from to _upto, and the first _head.

    A null source is one of its own; null and empty texts have size 0 and are
    never taken; null ids and repeated rows are kept, each on its own.  Equal
    documents are interchangeable.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = cut(
        docs.select(
            "doc_id", "source", F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"),
            F.size(ws_words(text)).cast("long").alias("size"),
            _key(docs, seed).alias("_key"),
        ),
        "sizes",
    )
    key = ["_none", "_name"]
    sources = sizes.groupBy(*key).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # There may be as many sources as hosts, so they are ranked and summed up in ranges.
    sources = ranked(sources, key).withColumn("weight", 1 + (F.col("_rank") - 1) % 3).drop("_rank")
    cap = most * F.col("source_size")
    filled = cut(ranked(sources.withColumn("_fill", cap / F.col("weight")), ["_fill", *key], caps=cap, weights=F.col("weight")), "filled")
    every = F.broadcast(filled.agg(F.sum("source_size").alias("_sum"), F.sum("weight").alias("_weights")))  # one row
    level = (F.col("_sum") - (F.col("caps") - cap)) / (F.col("_weights") - F.col("weights") + F.col("weight"))
    filled = filled.crossJoin(every).withColumn("_level", level)
    # The first source, by cap, that its level does not fill sets the level of all the rest.
    rest = filled.filter(F.col("_level") * F.col("weight") <= cap).agg(F.min(F.struct("_rank", "_level"))["_level"].alias("_rest"))  # one row
    target = F.least(cap.cast("double"), F.coalesce(F.col("_rest") * F.col("weight"), cap.cast("double")))
    seats = F.round(F.col("_sum") / block).cast("long")
    sources = filled.crossJoin(F.broadcast(rest)).select(*key, "source_size", "n_docs", target.alias("target"), seats.alias("_seats"))
    sources = apportion_all(cut(sources, "targets"), "target", "_seats", key)
    words_each = F.greatest(F.lit(float(SHARD_WORDS)), SHARD_WORDS / SHARD_DOCS * F.sqrt("source_size"))
    docs_each = F.greatest(F.lit(float(SHARD_DOCS)), F.sqrt("n_docs"))
    shards = F.greatest(F.ceil(F.col("source_size") / words_each), F.ceil(F.col("n_docs") / docs_each))
    sources = cut(sources.select(*key, "source_size", "target", "quota", shards.alias("n_shards")), "sources")
    small = broadcast_if_small(sources, 100_000)

    dealt = sizes.join(small, key).withColumn("shard", _seeded(F.lit("shard"), "_key") % F.col("n_shards"))
    parts = dealt.groupBy(*key, "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("source_quota"))
    parts = apportion(parts, key, "shard_size", "source_quota", ["shard"])
    words = F.least(F.col("quota") * block, most * F.col("shard_size"))
    run = _seeded(F.lit(str(seed)), "_name", F.col("_none").cast("string"), F.col("shard").cast("string"))
    some = F.when(F.col("shard_size") > 0, F.col("shard_size"))
    parts = parts.select(*key, "shard", "shard_size", F.floor(words / some).alias("passes"), (words % some).alias("rest"), (run % some).alias("_from"))
    parts = parts.withColumn("first", F.col("_from") - F.col("_from") % block)

    upto = F.sum("size").over(Window.partitionBy(*key, "shard").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("size")).join(parts, [*key, "shard"])
    # A place in the shard as a number of the document's words; the run goes on at the shard's beginning.
    word = lambda at: F.coalesce(F.least(F.greatest(at - F.col("_start"), F.lit(0)), F.col("size")), F.lit(0)).cast("long")
    last = F.col("first") + F.col("rest")
    placed = placed.withColumns({"_passes": F.coalesce("passes", F.lit(0)).cast("long"), "_upto": word(last), "_head": word(last - F.col("shard_size"))}).withColumn("_from", word(F.col("first")))
    taken = F.col("_passes") * F.col("size") + F.col("_upto") - F.col("_from") + F.col("_head")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "_key", "_passes", "_from", "_upto", "_head")


def op7_mixing(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row; see ``mix``.

    Very long texts are counted whole; columns besides doc_id, source and text only
    tell repeated rows apart."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them: whole copies as they are, and a row for
    each run of words that begins or ends inside a document, cut from its text.

    Documents that the mix does not reach are left out.  n_chars is brought up
    to date where it is there.
    """
    run = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    zero = F.lit(0).cast("long")
    runs = F.array(run(F.col("_from"), F.col("_upto")), run(zero, F.col("_head")))
    words = lambda r: r["b"] - r["a"]
    plan = mix(docs, seed).filter("taken > 0").withColumn("_runs", F.filter(runs, lambda r: words(r) > 0))
    plan = plan.withColumn("_whole", F.col("_passes") + F.size(F.filter("_runs", lambda r: words(r) == F.col("size"))))
    plan = plan.withColumn("_parts", F.filter("_runs", lambda r: words(r) < F.col("size")))
    # Repeated rows share a key: one of them takes what is taken of all.
    plan = plan.groupBy("_key").agg(F.sum("_whole").cast("int").alias("_whole"), F.flatten(F.collect_list(F.when(F.size("_parts") > 0, F.col("_parts")))).alias("_parts"))
    # Of repeated rows one is taken before the shuffle, so that many of them don't meet in a task.
    one = docs.select(F.struct("*").alias("_row"), _key(docs, seed).alias("_key")).dropDuplicates(["_key"]).join(plan, "_key")
    each = one.select("_row", F.explode(F.concat(F.array_repeat(run(zero, zero), F.col("_whole")), F.col("_parts"))).alias("_run"))
    pieces = F.split(F.btrim(F.col("_row.text"), F.lit(WS)), WORD_STARTS)
    some = F.slice(pieces, (F.col("_run.a") + 1).cast("int"), words(F.col("_run")).cast("int"))
    each = each.withColumn("_text", F.when(F.col("_run.b") > 0, F.btrim(F.array_join(some, ""), F.lit(WS))).otherwise(F.col("_row.text")))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return each.select(*(changed[c].alias(c) if c in changed else F.col("_row")[c].alias(c) for c in docs.columns))


def _apportion_sql(parties: str, group: str, votes: str, seats: str, order: str) -> str:
    """``parties`` with quota, by the same candidates as ``apportion``."""
    return f"""(WITH a AS (SELECT *, sum({votes}) OVER (PARTITION BY {group}) AS _total, count(*) OVER (PARTITION BY {group}) / 2.0 AS _n FROM {parties}),
  b AS (SELECT *, CASE WHEN _total > 0 THEN greatest(0, floor({votes}::DOUBLE / _total * ({seats} - _n) - 0.5) - 1) ELSE 0 END::BIGINT AS _sure,
    CASE WHEN _total > 0 THEN floor({votes}::DOUBLE / _total * ({seats} + _n) + 0.5) + 1 ELSE 0 END::BIGINT AS _most FROM a),
  c AS (SELECT *, {seats} - sum(_sure) OVER (PARTITION BY {group}) AS _open FROM b),
  d AS (SELECT *, unnest(range(_sure, _most + 1)) AS _k FROM c WHERE {votes} > 0),
  e AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {votes}::DOUBLE / (2 * _k + 1) DESC, {order}, _k) AS _rank FROM d),
  f AS (SELECT {group}, {order}, count(*) AS _won FROM e WHERE _rank <= _open GROUP BY {group}, {order})
  SELECT c.* EXCLUDE (_total, _n, _sure, _most, _open), (_sure + coalesce(_won, 0))::BIGINT AS quota FROM c LEFT JOIN f USING ({group}, {order}))"""


def op7_sql(seed: int = 7, most: int = MOST, block: int = BLOCK) -> str:
    """For ``documents`` with lang, source and n_chars beside doc_id and text."""
    seeded = lambda text: f"('0x' || substring(md5({text}), 1, 8))::BIGINT"
    field = lambda c, mark: f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":{mark}' || {c} || '{mark}' END"""
    word = lambda at: f"coalesce(least(greatest({at} - begin, 0), size), 0)"
    rest = "'{' || concat_ws(',', " + ", ".join((field("lang", '"'), field("source", '"'), field("n_chars", ""))) + ") || '}'"
    return rf"""
WITH sizes AS (
  SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
    md5(concat_ws(':', '{seed}', doc_id::VARCHAR, md5(coalesce(text, '')), md5({rest}))) AS key FROM documents),
s0 AS (SELECT none, name, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sizes GROUP BY ALL),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY none, name) - 1) % 3 AS weight, sum(source_size) OVER () AS whole, {most} * source_size AS cap FROM s0),
s2 AS (SELECT *, row_number() OVER w AS nth, (whole - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW w AS (ORDER BY cap::DOUBLE / weight, none, name)),
s3 AS (SELECT *, (SELECT arg_min(level, nth) FROM s2 WHERE level * weight <= cap) AS rest FROM s2),
s4 AS (SELECT none, name, source_size, n_docs, 1 AS every, round(whole / {block}.0)::BIGINT AS seats, least(cap::DOUBLE, coalesce(rest * weight, cap::DOUBLE)) AS target FROM s3),
s5 AS (SELECT *, greatest(ceil(source_size / greatest({float(SHARD_WORDS)}, {SHARD_WORDS / SHARD_DOCS} * sqrt(source_size))), ceil(n_docs / greatest({float(SHARD_DOCS)}, sqrt(n_docs))))::BIGINT AS n_shards
  FROM {_apportion_sql("s4", "every", "target", "seats", "none, name")}),
dealt AS (SELECT sizes.*, source_size, target, quota AS source_quota, {seeded("'shard:' || key")} % n_shards AS shard FROM sizes JOIN s5 USING (none, name)),
p0 AS (SELECT none, name, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS source_quota FROM dealt GROUP BY ALL),
p1 AS (SELECT *, least(quota * {block}, {most} * shard_size) AS words, nullif(shard_size, 0) AS room, {seeded(f"'{seed}:' || name || ':' || none || ':' || shard")} AS run
  FROM {_apportion_sql("p0", "none, name", "shard_size", "source_quota", "shard")}),
p2 AS (SELECT none, name, shard, shard_size, words // room AS passes, words % room AS left_, run % room - run % room % {block} AS first FROM p1),
placed AS (SELECT *, sum(size) OVER (PARTITION BY none, name, shard ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS begin FROM dealt JOIN p2 USING (none, name, shard))
SELECT doc_id, size, source_size, target, (coalesce(passes, 0) * size + {word("first + left_")} - {word("first")} + {word("first + left_ - shard_size")})::BIGINT AS taken FROM placed"""
