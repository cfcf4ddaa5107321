"""Fill-in-middle by DuckDB inside Arrow batches.

Each batch is registered with a DuckDB connection of the worker and one
statement cuts the texts into units, draws the two cuts and the form from a
hash of the id, and puts prefix, middle and suffix together; ``restore`` is
the way back.  Rows never become Python objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or the white space at the end.
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Bytes of text that one statement takes, but for a longer text, which is a batch of its own.
BYTES = 4 << 20

_FORMS = f"""
units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS u, sha256('{{seed}}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {{rows}}),
draws AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM units),
cuts AS (SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {{rate}} THEN 'plain' WHEN h4 % 100 < {{spm}} THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, 1, a), ''), '') END AS prefix,
  CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') END AS middle,
  CASE WHEN form <> 'plain' THEN coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') END AS suffix FROM cuts),
formed AS (SELECT doc_id, n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
  CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output FROM parts)"""

_BACK = """
back AS (SELECT *, CASE WHEN form <> 'plain' THEN regexp_split_to_array(output, '<[PSM]>') END AS x FROM {rows}),
restored AS (SELECT * EXCLUDE (x), CASE form WHEN 'psm' THEN x[2] || x[4] || x[3] WHEN 'spm' THEN x[3] || x[4] || x[2] ELSE output END AS restored FROM back)"""

_con = None


def _run(sql: str, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The statement's rows over a batch, in parts of at most ``BYTES`` of text."""
    import duckdb

    global _con
    if _con is None:  # one for each worker
        _con = duckdb.connect(config={"threads": 1})
    at = 0
    while at < batch.num_rows:
        n = min(1024, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > BYTES:
            n //= 2
        _con.register("batch", pa.Table.from_batches([batch.slice(at, n)]))
        yield from _con.sql(sql).to_arrow_table().to_batches()
        _con.unregister("batch")
        at += n


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``.

    Of texts that are not empty and hold no marker, ``rate`` percent by the hash
    of the id are rearranged, of these ``spm`` percent with the suffix first.
    The lengths count code points and are null for plain rows.  A null text is
    empty; null ids are drawn as an id without digits; repeated rows have a row
    each and draw alike; very long texts are cut whole, in a part of their own;
    an empty table gives an empty result; other columns are not looked at.
    """
    sql = f"WITH {_FORMS.format(rows='batch', seed=seed, rate=rate, spm=spm)} SELECT * FROM formed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _run(sql, batch)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(formed: DataFrame) -> DataFrame:
    """Adds ``restored``, the text that ``output`` was made from, to doc_id, form and output.

    Texts with markers are plain, so each marker stands once in the other forms.
    """
    sql = f"WITH {_BACK.format(rows='batch')} SELECT * FROM restored"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _run(sql, batch)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formed.schema)
    return formed.mapInArrow(run, f"{schema}, restored string")


def op11_infill(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of the output and of
    the text rebuilt from it; see ``fill_in_middle`` for odd rows."""
    out = restore(fill_in_middle(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op11_sql() -> str:
    """The same statements over the whole table."""
    forms, back = _FORMS.format(rows="documents", seed=42, rate=50, spm=80), _BACK.format(rows="formed")
    return f"WITH {forms},{back} SELECT doc_id::BIGINT AS doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM restored"
