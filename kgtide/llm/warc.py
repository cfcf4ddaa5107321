"""WARC archives in Zstandard, one frame a record.

An archive starts with a skippable frame that holds its dictionary; each record
is a frame of its own, so records can be read one by one.  Archives are written
by tasks to the shared folder through Arrow's file systems, under names no
other attempt uses; only the names that a successful attempt returns are read.
"""

from __future__ import annotations

import contextlib
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, scratch

#: Magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
#: Payloads shorter than this are never revisits.
LEAST = 100
#: Duplicated payloads up to which their table (a digest and an id each) is broadcast; archives that a task reads at most, where cores abound.
DUPLICATES, READ = 500_000, 16
#: Records from which a dictionary is trained, its bytes, and the plain bytes after which an archive ends.
SAMPLE, DICT_BYTES, ARCHIVE_BYTES = 200, 32_768, 64 << 20

_EPOCH = "1970-01-01T00:00:00Z"


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC/1.1 record.  A revisit has no block; its payload's digest and
    size stand in its header."""
    block = payload if kind == "response" else b""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_EPOCH}",
        "WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "%20" for c in url or ""),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from samples; empty if there are too few."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class Writer:
    """Writes one archive to a binary file object."""

    def __init__(self, out, samples: list[bytes]):
        self.out, held = out, train(samples) if len(samples) >= 8 else b""
        if held:
            packed = zstandard.ZstdCompressor(level=3).compress(held)
            out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.code = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held) if held else None)

    def write(self, rec: bytes) -> None:
        self.out.write(self.code.compress(rec))


def read_frames(file, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, each decoded from its own frame."""
    head = file.read(8)
    held, rest = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICT_MAGIC:
        data = file.read(struct.unpack("<II", head)[1])
        held = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data) if data[:4] == b"\x28\xb5\x2f\xfd" else data)
        rest = b""
    code = zstandard.ZstdDecompressor(dict_data=held)
    one, parts, begun = code.decompressobj(), [], False
    while True:
        if not rest:
            rest = file.read(chunk)
            if not rest:
                break
        parts.append(one.decompress(rest))
        rest, begun = b"", True
        if one.eof:
            yield b"".join(parts)
            rest = one.unused_data
            one, parts, begun = code.decompressobj(), [], False
    if begun:
        raise ValueError("an archive ends within a frame")


def parse(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a record; raises ValueError where they are not sound."""
    head, found, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not that of its header")
    block = rest[:size]
    if fields["WARC-Type"] == "response" and (len(block) != int(fields["X-Payload-Length"]) or hashlib.sha256(block).hexdigest() != fields["WARC-Payload-Digest"].removeprefix("sha256:")):
        raise ValueError("a payload is not that of its header")
    return fields, block


#: Hadoop's names of stores that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _open(folder: str):
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder
    scheme, _, rest = (folder if "://" in folder else folder.replace("file:", "file://", 1)).partition("://")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def _known(folder: str) -> bool:
    """Whether Arrow has the folder's file system."""
    try:
        _open(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def with_duplicates(pages: DataFrame) -> DataFrame:
    """Adds digest, size and refers_to.  Of rows with equal payloads of at least
    ``LEAST`` bytes, that with the smallest page_id is referred to by the others;
    rows with a null id, and repeated rows with the smallest id, refer to none.

    Only digests and ids are grouped.  Up to ``DUPLICATES`` duplicated payloads
    are looked up where the rows are read; beyond, rows are shuffled by digest,
    and AQE splits the partition of a payload that very many rows have.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload").cast("long")})
    groups = rows.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    groups = cut(groups.filter("n > 1 and least is not null").select("digest", "least"), "duplicates")
    found = rows.join(broadcast_if_small(groups, DUPLICATES), "digest", "left")
    return found.withColumn("refers_to", F.when(F.col("page_id") != F.col("least"), F.col("least"))).drop("least")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes records for rows of ``with_duplicates`` and returns the archives'
    names and record counts, as a written table.  Where only Spark knows the
    folder's file system, the archives' bytes stand in that table."""
    known = _known(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder) if known else (None, folder)

        def records() -> Iterator[bytes]:
            for batch in batches:
                cols = [batch.column(c) for c in ("page_id", "url", "digest", "size", "refers_to", "payload")]
                for row in zip(*cols, strict=True):
                    page_id, url, digest, size, refers_to, payload = (x.as_py() for x in row)
                    yield record("response" if refers_to is None else "revisit", page_id, url, digest, size, refers_to, payload)

        rows, done = records(), False
        while not done:
            first: list[bytes] = []
            held = 0
            for rec in rows:
                first.append(rec)
                held += len(rec)
                if len(first) >= SAMPLE or held >= ARCHIVE_BYTES:
                    break
            else:
                done = True
            if not first:
                break
            name, kept = f"{root}/{uuid.uuid4().hex}.warc.zst", io.BytesIO()
            if fs:
                fs.create_dir(root, recursive=True)
            with fs.open_output_stream(name) if fs else contextlib.nullcontext(kept) as out:
                archive, n = Writer(out, first), len(first)
                for rec in first:
                    archive.write(rec)
                while not done and held < ARCHIVE_BYTES:
                    rec = next(rows, None)
                    if rec is None:
                        done = True
                    else:
                        archive.write(rec)
                        n, held = n + 1, held + len(rec)
            yield pa.RecordBatch.from_pydict({"name": [name.rsplit("/", 1)[1]], "n": [n], "content": [None if fs else kept.getvalue()]}, schema=pa.schema([("name", pa.string()), ("n", pa.int64()), ("content", pa.binary())]))

    return cut(pages.mapInArrow(run, "name string, n long, content binary"), "archives")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of the named archives: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, and html with ``payloads``.

    Headers, lengths and digests are validated; an unsound archive fails.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payloads
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("html", pa.string())] * payloads)
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and len(s) > len("<urn:page:>") else None

    known = _known(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder) if known else (None, folder)
        for batch in batches:
            for name, n, content in zip(*batch.columns, strict=True):
                name, n, rows, seen = name.as_py(), n.as_py(), [], 0
                with fs.open_input_stream(f"{root}/{name}") if fs else io.BytesIO(content.as_py()) as file:
                    for rec in read_frames(file):
                        f, block = parse(rec)
                        row = (number(f["WARC-Record-ID"]), f["WARC-Target-URI"], int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"], number(f.get("WARC-Refers-To")))
                        rows.append((*row, block.decode()) if payloads else row)
                        seen += 1
                        if len(rows) >= 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                            rows = []
                if seen != n:
                    raise ValueError(f"{name} has {seen} records of {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)

    n, cores = archives.count(), archives.sparkSession.sparkContext.defaultParallelism
    # An explicit number, which AQE leaves alone: the names are tiny, what they name is not.
    parts = max(1, min(n, max(4 * cores, -(-n // READ))))
    return archives.select("name", "n", "content").repartition(parts).mapInArrow(run, schema)


def op8_warc(pages: DataFrame) -> DataFrame:
    """Writes all ``pages`` (page_id, url, html) to archives and reads them back.

    A null html is an empty payload.  Every row has its record, repeated rows and
    null ids too; of repeated rows with the smallest id of a payload all are
    responses.  An empty table gives an empty result.
    """
    folder = scratch(pages.sparkSession, "warc")
    archives = write_archives(with_duplicates(pages), folder)
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sql() -> str:
    return f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {LEAST} AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {LEAST} AND page_id <> least THEN least END AS refers_to
FROM g"""
