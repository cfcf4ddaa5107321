"""Near duplicates by SimHash and multi-index hashing.

Fingerprints are cut into two halves of 32 bits.  If two fingerprints differ in
at most four bits, then they differ in at most two bits of the low half, or in
at most one bit of the high one.  In the low half every fingerprint is stored
under all words of its radius-1 ball, and two words at distance two meet at the
words between them; in the high half the radius-1 ball is looked up among the
words themselves.  Each match is verified on all 64 bits.

Only distinct fingerprints take part.  Within one bucket of a table no list of
all pairs is made: verified fingerprints are united, a pair that is united
already is not looked at again, and a bucket yields at most one link for each
member.  Crowded buckets are first thinned by their most frequent fingerprint,
and what it does not reach is compared with the bucket in blocks.

``keep_one`` takes shingles of five words, fingerprints of 128 bits, and a distance
that SimHash expects of a similarity of 0.8, which is 19 bits.  The 128 bits are cut
into seven segments of 18 or 19.  Of two fingerprints within 19 bits, one of the first
six segments differs in at most two bits, or the last in at most one, as 6 * 3 + 2 is
20.  So all pairs meet in radius-1 balls, which are 135 words for each fingerprint;
chance lets 1 in 290 of all pairs meet.  With ``quarters`` they meet in radius-2 balls
of four segments: the same links from 2,116 words, where 1 in 25,000 meets.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

SHINGLE, RADIUS = 4, 4
#: For 128 bits.  A similarity of 0.8 is a cosine of 0.89, or 19.4 differing bits on average.
WIDE_SHINGLE, WIDE_RADIUS = 5, 19
#: Bits of the segments of a wide fingerprint, and whether stored balls meet there.
SEGMENTS, SEGMENTS_MEET = (18, 18, 18, 18, 19, 19, 18), (True,) * 6 + (False,)
#: Members of a bucket up to which all pairs are compared at once.
FEW = 64
#: Members that one task compares with each other; fingerprints that one task spreads over the tables.
BLOCK, SPREAD = 2048, 250_000
#: Fingerprints that one task spreads over the segments: two million rows, which it counts in memory.
DRAWN = 15_000
#: Buckets of use up to which their list (a key and a mark) is broadcast; beyond, members are shuffled to it.
LISTED = 2_000_000


def _hashes(text: str | None, shingle: int, digest: Callable[[bytes], bytes]) -> bytes:
    """Digests of all word shingles in turn, repeats included; of fewer words, of these."""
    words = text.encode().lower().split() if text else []
    if not words:
        return b""
    line = b" ".join(words)
    if len(words) <= shingle:
        return digest(line)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle].tolist()]
    return b"".join([digest(line[a:b]) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])


def _majority(hashes: bytes, size: int) -> bytes:
    """The bits, lowest first, that are set in over half of the digests of ``size`` bytes."""
    counts, n = np.zeros(8 * size, np.int64), len(hashes) // size
    for at in range(0, n, 65_536):
        part = np.frombuffer(hashes, np.uint8, min(n - at, 65_536) * size, at * size).reshape(-1, size)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > n, bitorder="little").tobytes()


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    digest = lambda x: xxhash.xxh64_intdigest(x, seed).to_bytes(8, "little")
    return int.from_bytes(_majority(_hashes(text, shingle, digest), 8), "little")


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE, seed: int = 42) -> bytes:
    """128-bit SimHash over word shingles, repeats included."""
    return _majority(_hashes(text, shingle, lambda x: xxhash.xxh3_128_digest(x, seed)), 16)


def _text_key() -> Column:
    return F.md5(F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and a key of the text of every row; null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), _text_key().alias("key"))
    return rows.mapInArrow(run, "doc_id long, fp long, key string")


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, the 128 bits as longs fp and fp2, and a key of the text of every row; null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.frombuffer(b"".join([wide_fingerprint(t.as_py()) for t in batch.column(1)]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits[:, 0]), pa.array(bits[:, 1]), batch.column(2)], names=["doc_id", "fp", "fp2", "key"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), _text_key().alias("key"))
    return rows.mapInArrow(run, "doc_id long, fp long, fp2 long, key string")


def unite(fps: np.ndarray, seen_by: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that hold the members together as all pairs within the radius would.

    ``fps`` has a row of words for each member.  From each member not yet
    reached, a search goes through the members left and takes what lies within
    the radius of a reached one.  ``seen_by`` marks members that may start or
    extend a link; a pair of unmarked members is not looked at.
    """
    left = np.arange(len(fps))
    links = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            there = left if seen_by[one] else left[seen_by[left]]
            near = there[np.bitwise_count(fps[there] ^ fps[one]).sum(1) <= radius]
            if len(near):
                links += [(int(one), int(x)) for x in near]
                todo += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return links


def ball_keys(rows: DataFrame, cols: list[str], parts: tuple[str, ...], ball: int = 1) -> DataFrame:
    """key, cols, n, flip: for each half of a part all words that differ in at most
    ``ball`` bits; flip numbers the bits that differ, 0 for none."""
    halves = [half for p in parts for half in (F.col(p).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(p, 32))]
    flips = [sum(1 << b for b in some) for k in range(ball + 1) for some in itertools.combinations(range(32), k)]
    masks = F.explode(F.array(*(F.struct(F.lit(i).cast("short").alias("flip"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(flips)))).alias("m")
    word = F.posexplode(F.array(*halves)).alias("at", "word")
    spread = rows.select(*cols, "n", word).select(*cols, "n", "at", "word", masks)
    return spread.select(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("word").bitwiseXOR(F.col("m.mask"))).alias("key"), *cols, "n", "m.flip")


def segment_keys(rows: DataFrame, cols: list[str], parts: tuple[str, ...]) -> DataFrame:
    """key, cols, n, flip: for each of ``SEGMENTS`` all words that differ in at most one
    bit; flip numbers the bit that differs, 0 for none."""
    low, high = parts
    words, lo = [], 0
    for width in SEGMENTS:
        word = F.shiftrightunsigned(high, lo - 64) if lo >= 64 else F.shiftrightunsigned(low, lo)
        if lo < 64 < lo + width:
            word = word.bitwiseOR(F.shiftleft(high, 64 - lo))
        words.append(word.bitwiseAND(F.lit((1 << width) - 1)))
        lo += width
    masks = [(at, flip, 1 << flip >> 1) for at, width in enumerate(SEGMENTS) for flip in range(width + 1)]
    each = F.explode(F.array(*(F.struct(F.lit(at).alias("at"), F.lit(flip).cast("short").alias("flip"), F.lit(m).cast("long").alias("mask")) for at, flip, m in masks))).alias("m")
    spread = rows.select(*cols, "n", F.array(*words).alias("words"), each)
    key = F.shiftleft(F.col("m.at").cast("long"), 32).bitwiseOR(F.col("words")[F.col("m.at")].bitwiseXOR(F.col("m.mask")))
    return spread.select(key.alias("key"), *cols, "n", "m.flip")


def paired(batches: Iterator[pa.RecordBatch], words: list[int], node: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links within the radius of rows (key, columns, start) sorted by key: in buckets of
    at most ``FEW`` members each pair of which one may start, in others what ``unite``
    finds.  ``words`` and ``node`` are places of columns."""

    def found(key: np.ndarray, cols: list[np.ndarray], start: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[begin, len(key)])
        last = np.repeat(begin + sizes, sizes)
        fps = np.stack([cols[w].view(np.uint64) for w in words], axis=1)
        names, pairs = cols[node], []
        at, by = np.flatnonzero(np.repeat(sizes <= FEW, sizes)), 1
        while len(at := at[at + by < last[at]]):
            near = (start[at] | start[at + by]) & (np.bitwise_count(fps[at] ^ fps[at + by]).sum(1) <= radius)
            pairs.append(np.stack([names[at[near]], names[at[near] + by]]))
            by += 1
        for i in np.flatnonzero(sizes > FEW):
            own = np.arange(begin[i], begin[i] + sizes[i])
            own = own[np.argsort(names[own])]
            links_ = np.array(unite(fps[own], start[own], radius), np.int64).reshape(-1, 2)
            pairs.append(names[own][links_].T)
        a, b = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1) if pairs else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rest: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
        whole = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on
        rest = [c[whole:] for c in now]
        if whole:
            yield found(now[0][:whole], [c[:whole] for c in now[1:-1]], now[-1][:whole])
    if rest is not None:
        yield found(rest[0], rest[1:-1], rest[-1])


def links(distinct: DataFrame, parts: tuple[str, ...] = ("fp",), node: str = "fp", meet: tuple[bool, ...] = (True, False), radius: int = RADIUS, ball: int = 1) -> DataFrame:
    """(a, b) pairs of distinct fingerprints that connect what lies within the radius.

    ``distinct`` is a written table with the words of a fingerprint in ``parts``,
    the ``node`` that names it, and n (rows with it).  ``meet`` tells for each half
    of a part, low and then high, whether stored balls meet there.  With no ``ball``
    the segments are ``SEGMENTS``.
    """
    cols = list(dict.fromkeys((node, *parts)))
    # Each fingerprint becomes many rows, so more tasks than the small table's files.
    tasks = max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // (SPREAD if ball else DRAWN)))
    spread = distinct.repartition(tasks, node)
    probed = ball_keys(spread, cols, parts, ball) if ball else segment_keys(spread, cols, parts)
    any_meet = F.shiftright("key", 32).isin([at for at, m in enumerate(meet if ball else SEGMENTS_MEET) if m])
    starts = (F.col("flip") == 0) | any_meet
    words_at, width = [cols.index(p) for p in parts], len(cols)
    if not ball:
        # Short segments leave few words alone, so only crowded buckets are told apart.
        sizes = cut(probed.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).select("key", F.lit(True).alias("many")), "buckets")
        listed = broadcast_if_small(sizes, LISTED, 128 << 20)
        plain = probed.join(listed, "key", "left_anti").select("key", *cols, starts.alias("start")).repartition("key").sortWithinPartitions("key")
        out = plain.mapInArrow(lambda batches: forest(paired(batches, words_at, cols.index(node), radius)), "a long, b long")
        return _crowded(out, sizes, probed.join(listed, "key"), cols, parts, node, radius)

    # A bucket is of use if a member is at home there (no bit flipped) or, where
    # balls meet, if two words do; equal words meet at home.
    sizes = probed.groupBy("key").agg(F.count("*").alias("size"), F.min("flip").alias("least"), F.max("flip").alias("most"))
    sizes = cut(sizes.filter((F.col("size") > 1) & ((F.col("least") == 0) | (any_meet & (F.col("least") != F.col("most"))))).select("key", (F.col("size") > BLOCK).alias("many")), "buckets")
    member = probed.join(broadcast_if_small(sizes, LISTED, 128 << 20), "key")
    listed = [F.collect_list(F.when(c, F.col(x))).alias(f"{side}{i}") for side, c in (("h", starts), ("g", ~starts)) for i, x in enumerate(cols)]
    plain = member.filter(~F.col("many")).groupBy("key").agg(*listed).drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*batch.columns, strict=True):
                lists = [x.as_py() for x in row]
                # By name, so that buckets with the same members give the same links.
                members = sorted(zip(*lists[:width], strict=True)), sorted(zip(*lists[width:], strict=True))
                first = len(members[0])
                every = list(zip(*members[0], *members[1], strict=True))
                names, words = every[0], [every[i] for i in words_at]
                if first * len(names) <= 64:
                    part = list(range(len(names)))  # members that are linked already
                    for i in range(first):
                        own = [w[i] for w in words]
                        for j in range(i + 1, len(names)):
                            if part[i] != part[j] and sum([((x ^ w[j]) & 0xFFFFFFFFFFFFFFFF).bit_count() for x, w in zip(own, words, strict=True)]) <= radius:
                                found.append((names[i], names[j]))
                                part = [part[i] if x == part[j] else x for x in part]
                else:
                    fps = np.array(words, np.int64).T.copy().view(np.uint64)
                    found += [(names[i], names[j]) for i, j in unite(fps, np.arange(len(names)) < first, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return _crowded(plain.mapInArrow(run, "a long, b long"), sizes, member, cols, parts, node, radius)


def _crowded(out: DataFrame, sizes: DataFrame, member: DataFrame, cols: list[str], parts: tuple[str, ...], node: str, radius: int) -> DataFrame:
    """``out`` with the links of crowded buckets.

    What lies near the pivot is linked to it and so united.  A pair can connect
    something new only if one of its members is not.
    """
    if not sizes.filter("many").limit(1).count():
        return out
    many = member.filter("many").select("key", *cols, "n")
    pivots = many.groupBy("key").agg(F.max(F.struct("n", *cols)).alias("pivot"))
    distance = reduce(Column.__add__, [F.bit_count(F.col(p).bitwiseXOR(F.col(f"pivot.{p}"))) for p in parts])
    many = many.join(pivots, "key").withColumn("near", distance <= radius)
    many = cut(many.select("key", *cols, "near", F.col(f"pivot.{node}").alias("pivot")), "crowded")
    star = many.filter(F.col("near") & (F.col(node) != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col(node).alias("b"))
    far = many.filter(~F.col("near"))
    n_far = far.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("far_blocks"))
    n_all = many.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("all_blocks"))
    grid = cut(n_far.join(n_all, "key"), "grid")
    block = lambda n: F.pmod(F.xxhash64(node, "key"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = far.join(grid, "key").select("key", *cols, F.lit(True).alias("far"), block("far_blocks").alias("x"), each("all_blocks").alias("y"))
    against = many.join(grid, "key").select("key", *cols, F.lit(False).alias("far"), each("far_blocks").alias("x"), block("all_blocks").alias("y"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        every = pdf.sort_values("far", ascending=False).drop_duplicates(node)
        fps = np.ascontiguousarray(every[list(parts)].to_numpy(np.int64)).view(np.uint64)
        names = every[node].to_numpy(np.int64)
        found = unite(fps, every["far"].to_numpy(bool), radius)
        return pd.DataFrame({"a": [names[i] for i, _ in found], "b": [names[j] for _, j in found]}, dtype="int64")

    rest = rows.unionByName(against).groupBy("key", "x", "y").applyInPandas(across, "a long, b long")
    return out.unionByName(star).unionByName(rest)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links (a, b) those that join what was apart, by union-find."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for batch in batches:
        kept = []
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                above[max(p, q)] = min(p, q)
                kept.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([y for _, y in kept], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node -> root (smallest node of its component) for every node of ``edges``
    (a, b) but the roots, by alternating large-star and small-star rounds, each written to the
    shared folder, until nothing changes.  Tasks first thin the links out, at most
    ``SPREAD`` each, as many say the same."""
    raw = cut(edges.select("a", "b").filter("a != b"), "links")
    thin = raw.coalesce(max(2, -(-raw.count() // SPREAD))).mapInArrow(forest, "a long, b long")
    now = cut(thin.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A hub's links are many: the minimum is aggregated first and joined back, which AQE can split.
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = low.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        now = cut(small, "edges")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new
    raise RuntimeError("components did not settle")


def _rooted(rows: DataFrame, wide: bool = False, quarters: bool = False) -> DataFrame:
    """Each distinct fingerprint of ``rows`` with n, its least id and first row, and
    root, the smallest node of its component."""
    parts = ("fp", "fp2") if wide else ("fp",)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    distinct = rows.groupBy(*parts).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), first)
    node = F.monotonically_increasing_id() if wide else F.col("fp")
    distinct = cut(distinct.withColumn("node", node), "distinct")
    found = links(distinct, parts, "node", (True,) * 4, WIDE_RADIUS, 2 if quarters else 0) if wide else links(distinct)
    return distinct.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row, read once.

    component_id is the smallest doc_id among all rows of the component; rows
    with a null id take part, and have null where no row has an id.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    labelled = _rooted(rows)
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    # A component may hold a third of all fingerprints and a fingerprint a third of all rows: AQE splits both sides' hot partitions.
    label = labelled.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(label, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Null and empty texts have fingerprint zero and link as any other; very long
    texts are read whole; other columns are not looked at.  Repeated
    rows have a row each; null ids take part, and a component of these alone has a
    null id.  An empty table gives an empty result.
    """
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, quarters: bool = False) -> DataFrame:
    """One row of each near-duplicate component of ``docs``, with its columns.

    Near duplicates are all of ``wide_fingerprints`` within ``WIDE_RADIUS``; for
    ``quarters`` see above.  Null and
    empty texts are alike; very long texts are read whole; other columns stay as
    they are, whatever their names.  The row with the smallest doc_id stays, null last; of several texts with that id
    the one with the smallest key, and of repeated rows one.
    """
    kept = _rooted(cut(wide_fingerprints(docs), "fingerprints"), True, quarters).groupBy("root").agg(F.min("first").alias("first"))
    name = lambda doc, text: F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).alias("_name")
    kept = kept.select(name(F.col("first.doc_id"), F.col("first.key")))
    # Repeated rows come down to one before the shuffle, whose partitioning the join takes over.
    rows = docs.select(F.struct("*").alias("_row"), name(F.col("doc_id").cast("long"), _text_key())).dropDuplicates(["_name"])
    return rows.join(kept, "_name", "left_semi").select("_row.*")
