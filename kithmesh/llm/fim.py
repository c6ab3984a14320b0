"""Fill-in-middle transformation by DuckDB SQL inside mapInArrow (op 11).

A text is cut into units: white space and the run of other characters after it, or white space at the end. Two hashed draws of the
document's id choose where the prefix and the middle end. A third one says if the text stays plain, a fourth if the parts are written
prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each after its marker. Every worker registers each Arrow batch, in blocks of bounded bytes, as
a table of an in-memory DuckDB, and returns the Arrow result of one statement: no Python runs per row. Draws depend on seed and id
alone, so a task that is run again gives the same rows. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space and the word after it, or white space alone.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_BLOCK = 4 << 20  # bytes of text that DuckDB holds at once, or one text


def _draw(k: int) -> str:
    """The k-th group of eight hex digits of h as a number."""
    return f"('0x' || substr(h, {8 * k - 7}, 8))::BIGINT"


def _between(text: str, start: str, end: str | None) -> str:
    """What stands after the only `start` and before the only `end` (or the text's end)."""
    rest = f"string_split({text}, '{start}')[2]"
    return f"string_split({rest}, '{end}')[1]" if end else rest


def _rebuilt(text: str, form: str) -> str:
    """The original text from an output and its form. No part holds a marker, and none arises where a marker meets a part: markers begin
    with '<' and end with '>', so one that overlapped a real one would have to begin inside it."""
    psm = f"{_between(text, PREFIX, SUFFIX)} || {_between(text, MIDDLE, None)} || {_between(text, SUFFIX, MIDDLE)}"
    spm = f"{_between(text, PREFIX, MIDDLE)} || {_between(text, MIDDLE, None)} || {_between(text, SUFFIX, PREFIX)}"
    return f"CASE {form} WHEN 'psm' THEN {psm} WHEN 'spm' THEN {spm} ELSE {text} END"


def statement(seed: int, rate: int, spm: int) -> str:
    """SQL over the table `batch` (id, text), giving id, n, form, prefix_chars, middle_chars and output."""
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH units AS (SELECT id, text, regexp_extract_all(text, '{UNIT}') AS u, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h FROM batch),
drawn AS (SELECT id, text, u, len(u) AS n, {_draw(1)} % (len(u) + 1) AS x, {_draw(2)} % (len(u) + 1) AS y,
  CASE WHEN text = '' OR {marked} OR {_draw(3)} % 100 >= {rate} THEN 'plain' WHEN {_draw(4)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT id, text, n, form, array_to_string(list_slice(u, 1, least(x, y)), '') AS p,
  array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') AS m, array_to_string(list_slice(u, greatest(x, y) + 1, n), '') AS s FROM drawn)
SELECT id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END AS output
FROM parts"""


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(sizes[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + _BLOCK, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _run(batches: Iterator[pa.RecordBatch], sql: str, fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    import duckdb

    schema = pa.schema(fields)
    db = duckdb.connect(":memory:", config={"threads": 1})
    try:
        for batch in batches:
            for block in _blocks(batch):
                db.register("batch", pa.Table.from_batches([block]))
                yield from db.sql(sql).to_arrow_table().select(schema.names).cast(schema).to_batches()
                db.unregister("batch")
    finally:
        db.close()


_KINDS = {"long": pa.int64(), "string": pa.string()}


def _mapped(rows: DataFrame, sql: str, columns: dict[str, str]) -> DataFrame:
    fields = [(name, _KINDS[kind]) for name, kind in columns.items()]
    return rows.mapInArrow(partial(_run, sql=sql, fields=fields), ", ".join(f"{n} {k}" for n, k in columns.items()))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))


_FACTS = {"id": "long", "n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}


def transformed(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain), output of every whole text.

    `rate` of 100 texts are rearranged, `spm` of 100 of those as spm. Null texts are empty. Empty texts, and texts that hold a marker, stay plain. A
    null id draws as the empty text does. Repeated rows give a row each, and rows of one id the same draws (their cuts depend on their units). An empty
    table gives an empty result; other columns aren't read."""
    return _mapped(_rows(docs, id_col, text_col), statement(seed, rate, spm), _FACTS | {"output": "string"}).withColumnRenamed("id", "doc_id")


def restored(outputs: DataFrame) -> DataFrame:
    """doc_id and text of rows (doc_id, form, output) as `transformed` gives them; the text of a null output is empty."""
    rows = outputs.select(F.col("doc_id").cast("long").alias("id"), "form", text_of("output").alias("text"))
    return _mapped(rows, f"SELECT id, {_rebuilt('text', 'form')} AS restored FROM batch", {"id": "long", "restored": "string"}).toDF("doc_id", "text")


def digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `transformed`, with the sha256 of the output and of the text rebuilt from output and form in place of the output, so that no text
    leaves the worker."""
    made = statement(seed, rate, spm)
    sql = f"SELECT id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({_rebuilt('output', 'form')}) AS restored_sha256 FROM ({made})"
    return _mapped(_rows(docs, id_col, text_col), sql, _FACTS | {"output_sha256": "string", "restored_sha256": "string"}).withColumnRenamed("id", "doc_id")
