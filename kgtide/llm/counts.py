"""Token counts by a two-tier lookup where the texts are read.

No merge of the vocabulary crosses from a character into the white space after
it, so a text's count is the sum of the counts of its pre-tokens: runs of
spaces with what follows up to the next.  A table of frequent pre-tokens and
their lengths is broadcast; what it lacks goes to the worker's own cache, and
from there to the library.  Pre-tokens are never shuffled.

The frequent table comes from a bounded sample of documents and only saves
time: counts do not depend on it.  A vocabulary that joins across spaces is
noticed when it is loaded, and texts then go to the library whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of the sample, pre-tokens that each task names, and entries of the broadcast table.
SAMPLE, NAMED, ENTRIES = 2_000, 2_048, 65_536
#: Entries at which a worker's cache is emptied, the longest pre-token it keeps, and characters looked up at a time.
CACHE, LONGEST, CHUNK = 300_000, 64, 1_000_000

_RUNS = re.compile("[ ▁]+[^ ▁]*")
_BETWEEN = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

_counters: dict[str, Counters] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space; the library puts one
    before the text."""
    if "  " in text or "▁" in text or text[:1] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")


def chunks(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` characters, cut at single spaces before pre-tokens, which go."""
    at = 0
    while len(text) - at > size:
        cut = _BETWEEN.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class Tier(dict):
    """The first tier; what it lacks is in the second."""

    second: dict[str, int]

    def __missing__(self, piece: str) -> int:
        return self.second[piece]


class Counters:
    """The library with this worker's cache in front of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.begins = np.array([x.startswith("▁") for x in names])
        # One space is a token of its own, and no name goes on after a space.
        trial = "a b  c▁ ▁d \n e "
        self.by_pieces = not any(re.search("[^▁]▁", x) for x in names) and self.library.encode("a ") == [*self.library.encode("a"), self.library.piece_to_id("▁")]
        self.by_pieces = self.by_pieces and sum(self._each(pre_tokens(trial))) == len(self.library.encode(trial))
        self.cache: dict[str, int] = {}
        self.frequent = Tier()
        self.source: bytes | None = None

    def _each(self, pieces: list[str]) -> list[int]:
        return [len(x) if p else 1 for p, x in zip(pieces, self.library.encode(pieces, num_threads=1), strict=True)]

    def _encode(self, pieces: list[str]) -> list[int]:
        """Counts of pre-tokens.

        Those without spaces inside are encoded as one line, in which each begins
        at a name that begins with a space.
        """
        plain = [i for i, x in enumerate(pieces) if x and " " not in x and "▁" not in x]
        ids = np.array(self.library.encode(" ".join([pieces[i] for i in plain])), np.int64)
        starts = np.flatnonzero(self.begins[ids])
        if len(starts) != len(plain):
            return self._each(pieces)
        out = np.zeros(len(pieces), np.int64)
        out[plain] = np.diff(starts, append=len(ids))
        odd = np.flatnonzero(out == 0).tolist()
        if odd:
            out[odd] = self._each([pieces[i] for i in odd])
        return out.tolist()

    def take(self, table: tuple[bytes, bytes]) -> None:
        """Makes ``table`` the first tier."""
        if self.source is not table[0]:
            self.source, self.cache = table[0], {}
            self.frequent = Tier(zip(table[0].decode().split(" "), np.frombuffer(table[1], np.uint16).tolist(), strict=True) if table[1] else ())

    def pieces_of(self, texts: list[str]) -> list[int]:
        """Counts of texts that are not empty, by their pre-tokens."""
        found = [pre_tokens(x) for x in texts]
        frequent, cache = self.frequent, self.cache
        new = set().union(*found).difference(frequent, cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set().union(*found).difference(frequent)
        todo = list(new)
        for at in range(0, len(todo), 8192):
            cache.update(zip(todo[at : at + 8192], self._encode(todo[at : at + 8192]), strict=True))
        frequent.second = cache
        out = [sum(map(frequent.__getitem__, pieces)) for pieces in found]
        if len(cache) > CACHE:
            cache.clear()
        for x in todo:
            if len(x) > LONGEST:
                cache.pop(x, None)
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        """Counts of whole texts; null and empty ones have none."""
        out, short, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_pieces:
                out[i] = len(self.library.encode(text))
            elif len(text) > CHUNK:
                out[i] = sum(self.pieces_of([part])[0] for part in chunks(text, CHUNK))
            else:
                short.append(i)
                size += len(text)
                if size >= CHUNK:
                    self._fill(out, short, texts)
                    short, size = [], 0
        self._fill(out, short, texts)
        return out

    def _fill(self, out: list[int], at: list[int], texts: list[str | None]) -> None:
        for i, n in zip(at, self.pieces_of([texts[i] for i in at]), strict=True):
            out[i] = n


def counters(path: str) -> Counters:
    """This process's counters for a model file."""
    if path not in _counters:
        _counters[path] = Counters(path)
    return _counters[path]


def frequent_table(docs: DataFrame, model: str, sample: int = SAMPLE, entries: int = ENTRIES) -> tuple[bytes, bytes]:
    """Frequent pre-tokens joined by spaces, and their lengths as 16-bit numbers.

    ``sample`` bounds the documents that are looked at, and each task names at
    most ``NAMED`` pre-tokens, so the driver gets at most their product.
    """
    n = docs.count()
    some = docs.select(F.col("text").cast("string")).sample(min(1.0, sample / max(n, 1)), seed=13)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in chunks(text.as_py() or "", CHUNK):
                    found.update(x for x in pre_tokens(part) if 0 < len(x) <= LONGEST and " " not in x)
                    if len(found) > CACHE:
                        found = Counter(dict(found.most_common(NAMED)))
        top = found.most_common(NAMED)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64())], names=["piece", "n"])

    total: Counter[str] = Counter()
    named = some.mapInArrow(name, "piece string, n long").toArrow().to_pydict()
    for piece, k in zip(named["piece"], named["n"], strict=True):
        total[piece] += k
    top = [x for x, k in total.most_common(entries) if k > 1]
    lengths = counters(model)._encode(top)
    return " ".join(top).encode(), np.array(lengths, np.uint16).tobytes()


def token_counts(docs: DataFrame, model: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row, without begin and end.

    Null and empty texts have none; null ids and repeated rows have a row each;
    very long texts are counted whole, in parts cut between pre-tokens; an empty
    table gives an empty result; other columns are not looked at.
    """
    path = model or default_model()
    held = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counters(path)
        count.take(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count.counts(part.column(2).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def op13_token_counts(docs: DataFrame, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether these exceed ``limit``; see ``token_counts`` for odd rows."""
    return token_counts(docs).withColumn("over_limit", F.col("n_tokens") > limit)
