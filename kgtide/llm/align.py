"""Token alignment of two vocabularies by bitsets of token ends.

A text's bytes carry two bitsets, one for each vocabulary, that mark where its
tokens end.  Their AND has the shared cuts, counts of bits before a cut rank it
among both vocabularies' tokens, and the ranks cut both token lists into groups;
a group's last tokens end together and are linked.

No token of either vocabulary holds a character and the white space after it,
so a text is aligned by its pieces: a space with what follows up to the next
space after a character.  Pieces that a worker has met are kept with their groups
and links; new ones are aligned together, in one bitset.  Spark counts the links
over the whole corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

#: Entries at which a worker's cache is emptied, the longest piece it keeps, and characters aligned at a time.
CACHE, LONGEST, CHUNK = 200_000, 64, 500_000
#: Pairs of ids up to which their counts are broadcast; beyond, links are shuffled to them.
LISTED = 2_000_000

#: Where a long text may be cut: no token of either vocabulary holds a character and the space after it.
_BETWEEN, _RUN = re.compile(r"(?<=\S) "), re.compile(r"\s ")

_aligners: dict[tuple[str, str], Aligner] = {}


def vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The byte of each letter in byte-level vocabularies: printable Latin-1 signs
    stand for themselves, and the other bytes, in turn, for what follows U+00FF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def packed(ends: np.ndarray, size: int) -> np.ndarray:
    """A bitset of 64-bit words with the bits before the given byte ends set."""
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[ends - 1] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def ranks(bitset: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many bits are set up to each cut."""
    before = np.concatenate([[0], np.bitwise_count(bitset).cumsum(dtype=np.int64)])
    word, bit = (cuts - 1) >> 6, ((cuts - 1) & 63).astype(np.uint64)
    upto = bitset[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit))
    return before[word] + np.bitwise_count(upto)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The byte offsets where tokens of both lists end, and their ranks in each list."""
    a, b = packed(ends_a, size), packed(ends_b, size)
    cuts = np.flatnonzero(np.unpackbits((a & b).view(np.uint8), bitorder="little")) + 1
    return cuts, ranks(a, cuts), ranks(b, cuts)


class Aligner:
    """Both vocabularies, with this worker's cache of the second one's ids.

    ``a`` is a byte-level vocabulary file of the tokenizers library, whose ids
    its merges follow in order; ``b`` a sentencepiece model with byte fallback.
    """

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["id"] for x in model["added_tokens"]}
        letters = byte_letters()
        names_a = {i: bytes(letters[c] for c in token) for token, i in model["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in names_a.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [names_a.get(i, b"") for i in range(max(names_a) + 1)]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in names]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in some], np.int64) for some in (self.a_bytes, self.b_bytes))
        # Each id with the sign after it: a, a| and b, b; in turn.
        n = len(self.a_bytes)
        self.written = [f"{i},".encode() for i in range(n)] + [f"{i}|".encode() for i in range(n)] + [f"{i},".encode() for i in range(len(names))] + [f"{i};".encode() for i in range(len(names))]
        self.written_sizes = np.array([len(x) for x in self.written], np.int64)
        self.space = self.b.piece_to_id("▁")
        self.by_pieces = not any(re.search("[^▁]▁", x) for x in names) and self.b.encode("a ")[-1:] == self.b.encode("b ")[-1:] == [self.space]
        self.cache: dict[str, tuple[bytes, bytes, int]] = {}

    def align(self, text: str) -> tuple[np.ndarray, ...] | None:
        """Ids of a space with the text by both vocabularies, the offsets of their shared
        cuts, and how many ids of each end up to a cut; None where the bytes of
        the tokens are not those of the text."""
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text) if text else [self.space]
        whole = (" " + text).encode()
        if not b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b)):
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, b, *shared_cuts(self.a_sizes[a].cumsum(), self.b_sizes[b].cumsum(), len(whole))

    def write(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3;`` and where each group ends in it."""
        n, m = len(self.a_bytes), len(self.b_bytes)
        at_a, at_b = a.copy(), b + 2 * n
        at_a[upto_a - 1] += n
        at_b[upto_b - 1] += m
        out = np.empty(len(a) + len(b), np.int64)
        before_b, sizes_a, sizes_b = np.append(0, upto_b[:-1]), np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        out[np.arange(len(a)) + np.repeat(before_b, sizes_a)] = at_a
        out[np.arange(len(b)) + np.repeat(upto_a, sizes_b)] = at_b
        return b"".join(map(self.written.__getitem__, out.tolist())), self.written_sizes[out].cumsum()[upto_a + upto_b - 1]

    def _line(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes, int]] | None:
        """Pieces aligned as one line: for each its groups as text, its links as packed
        longs (id of a << 32 | id of b), and n_a << 32 | n_b."""
        got = self.align(" ".join(pieces))
        if got is None:
            return None
        a, b, cuts, upto_a, upto_b = got
        links = (a[upto_a - 1] << 32 | b[upto_b - 1]).astype("<i8").tobytes()
        text, ends = self.write(a, b, upto_a, upto_b)
        last = np.searchsorted(cuts, np.cumsum([len(x.encode()) + 1 for x in pieces]))  # a piece ends with a cut
        tokens = np.diff(upto_a[last] << 32 | upto_b[last], prepend=0).tolist()
        at, to = [0, *ends[last].tolist()], [0, *(8 * (last + 1)).tolist()]
        return {x: (text[i : j - 1], links[k:m], n) for x, i, j, k, m, n in zip(pieces, at, at[1:], to, to[1:], tokens)}

    def learn(self, pieces: set[str]) -> list[str]:
        """Aligns what is new among ``pieces``, and names it."""
        new = pieces.difference(self.cache)
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = pieces
        # White space at a piece's end would run into the next piece.
        plain = [x for x in new if x and not x[-1].isspace()]
        odd = [x for x in new if not x or x[-1].isspace()]
        for at in range(0, len(plain), 8192):
            got = self._line(plain[at : at + 8192])
            if got is None:
                odd += plain[at : at + 8192]
            else:
                self.cache.update(got)
        for x in odd:
            self.cache.update(self._line([x]) or {x: (b"", b"", -1)})
        return [x for x in new if len(x) > LONGEST]

    def documents(self, texts: list[str | None]) -> list[tuple | None]:
        """What ``document`` gives for each text; texts of up to ``CHUNK`` characters together."""
        out: list[tuple | None] = []
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at] or "")
            while end < len(texts) and size + len(texts[end] or "") <= CHUNK:
                size += len(texts[end] or "")
                end += 1
            if end - at > 1 and self.by_pieces:
                some = [split(x) if x and "▁" not in x else None for x in texts[at:end]]
                long = self.learn(set().union(*(x for x in some if x)))
                out += [self._sum([x]) if x else None for x in some]
                self._forget(long)
            else:
                out += [self.document(x) for x in texts[at:end]]
            at = end
        return out

    def _forget(self, pieces: list[str]) -> None:
        for x in pieces:
            self.cache.pop(x, None)

    def _learned(self, parts: Iterator[list[str]]) -> Iterator[list[str]]:
        for pieces in parts:
            long = self.learn(set(pieces))
            yield pieces
            self._forget(long)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, some at a time."""
        at = 0
        while len(text) - at > CHUNK and self.by_pieces:
            end = _BETWEEN.search(text, at + CHUNK)
            if not end:
                break
            yield split(text[at : end.start()])
            at = end.end()
        yield split(text[at:]) if self.by_pieces else [text]

    def document(self, text: str | None) -> tuple | None:
        """n_a, n_b, n_groups, the digest of the groups, and the linked pairs with
        their numbers; None where a text has no tokens."""
        return self._sum(self._learned(self.parts(text))) if text and "▁" not in text else None

    def _sum(self, parts: Iterable[list[str]]) -> tuple | None:
        digest, tokens, links, mark = hashlib.sha256(), 0, [], b""
        for pieces in parts:
            groups, linked, sizes = zip(*map(self.cache.__getitem__, pieces), strict=True)
            if min(sizes) < 0:
                return None
            tokens += sum(sizes)
            digest.update(mark + b";".join(groups))
            mark = b";"
            links.append(np.unique(np.frombuffer(b"".join(linked), "<i8"), return_counts=True))
        pairs, times = links[0]
        if len(links) > 1:
            pairs, at = np.unique(np.concatenate([x for x, _ in links]), return_inverse=True)
            times = np.bincount(at, np.concatenate([x for _, x in links])).astype(np.int64)
        return tokens >> 32, tokens & 0xFFFFFFFF, int(times.sum()), digest.hexdigest(), pairs, times


def split(text: str) -> list[str]:
    """Pieces that no token leaves, each without the space before it: spaces after
    white space belong to the run before them."""
    return _BETWEEN.split(text) if _RUN.search(text) or text[:1] == " " else text.split(" ")


def aligner(a: str, b: str) -> Aligner:
    """This process's aligner for two vocabulary files."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


_ROW = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<long>"


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and the linked pairs of ids
    (a << 32 | b) with how often each is linked, for every row of ``docs``.

    Texts that are null, empty, or whose tokens' bytes are not a space and the
    text have zeros, '' and no pairs.  Null ids and repeated rows have a row
    each; very long texts are aligned whole, some pieces at a time; an empty
    table gives an empty result; other columns are not looked at.
    """
    paths = (a or vocabularies()[0], b or vocabularies()[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligned = aligner(*paths)
        none = (0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_a, n_b, n_groups, digests, pairs, times = zip(*(x or none for x in aligned.documents(part.column(1).to_pylist())), strict=True)
                ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)]
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, _ROW)


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, count and whether no other a of this b has more, over all of ``aligned``."""
    pairs = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    pairs = pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def op12_alignment(docs: DataFrame) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row;
    see ``alignments`` for odd rows.  A group's last tokens are its one link, as
    no token is without bytes."""
    rows = cut(alignments(docs).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = broadcast_if_small(cut(link_counts(rows), "links"), LISTED, 128 << 20)
    own = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    # A pair may be in most rows: AQE splits its partition where the counts are not broadcast.
    links = rows.select(*own, F.explode_outer(F.arrays_zip("pairs", "times")).alias("x")).select(*own, F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    sums = links.join(counts, "pair", "left").groupBy(*own).agg(
        F.coalesce(F.sum("times"), F.lit(0)).alias("n_links"), F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"), F.coalesce(F.sum(F.col("times") * F.col("count")), F.lit(0)).alias("count_sum")
    )
    return sums.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
