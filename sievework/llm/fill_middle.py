"""Fill-in-the-middle transformation: texts cut at two places between tokens and written out of order with sentinels, by DuckDB SQL over the Arrow batches of each task.

The places and the form come from the SHA-256 of the seed and the document's id, so that a task that runs again gives the same. A text stays as it is (form plain) if it is empty, holds a sentinel already, or the dice say so; else it is psm (prefix, suffix, middle) or spm (suffix, prefix, middle). `restore` gives the text back from output and form alone."""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievework.llm.common import bounded_batches, columns

SEED, RATE, SPM_RATE = 42, 50, 80  # of 100 texts transformed; of 100 of these written suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Bound of what DuckDB holds in a task: a batch, its tokens and its output.
MEMORY = "1GB"

_word = lambda k: f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT)"
TRANSFORM = rf"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM batch
), cut AS (
  SELECT *, regexp_extract_all(text, '{TOKEN}') AS tokens FROM own
), placed AS (
  SELECT *, len(tokens) AS n, {_word(1)} % (len(tokens) + 1) AS a, {_word(2)} % (len(tokens) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_word(3)} % 100 >= {RATE} THEN 'plain' WHEN {_word(4)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, n, form, text,
    array_to_string(list_slice(CASE WHEN form <> 'plain' THEN tokens END, 1, least(a, b)), '') AS prefix,
    array_to_string(list_slice(CASE WHEN form <> 'plain' THEN tokens END, least(a, b) + 1, greatest(a, b)), '') AS middle,
    array_to_string(list_slice(CASE WHEN form <> 'plain' THEN tokens END, greatest(a, b) + 1, n), '') AS suffix
  FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
FROM parts
"""
_OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: The three pieces stand between the sentinels, none of which they hold.
_between = lambda a, b: f"substr(output, strpos(output, '{a}') + {len(a)}, strpos(output, '{b}') - strpos(output, '{a}') - {len(a)})"
_after = f"substr(output, strpos(output, '{MIDDLE}') + {len(MIDDLE)})"
RESTORED = f"CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {_between(PREFIX, SUFFIX)} || {_after} || {_between(SUFFIX, MIDDLE)} ELSE {_between(PREFIX, MIDDLE)} || {_after} || {_between(SUFFIX, PREFIX)} END"


def in_duckdb(df: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows of `sql`, which reads the view `batch`, over each Arrow batch of df."""
    bounded_batches(df.sparkSession)
    names = T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        try:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().select(names).to_batches()
                con.unregister("batch")
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n (tokens), form (plain, psm, spm), prefix_chars and middle_chars (code points, null if plain) and output.

    A null text is an empty one, and plain. A null id counts as the empty string where places are drawn. Repeated rows come out alike. Texts of any length are cut whole; a batch holds some 4 MB or one longer text. Further columns are ignored, whatever their names. No rows give no rows."""
    own = columns(docs, "doc_id", "text")
    return in_duckdb(own.select(own.doc_id.cast("long").alias("doc_id"), own.text.cast("string").alias("text")), TRANSFORM, _OUTPUT)


def restore(formatted: DataFrame) -> DataFrame:
    """doc_id and text, rebuilt from output and form."""
    return in_duckdb(columns(formatted, "doc_id", "form", "output"), f"SELECT doc_id, {RESTORED} AS text FROM batch", "doc_id long, text string")


def round_trip(formatted: DataFrame) -> DataFrame:
    """What fill_in_middle gave, with the SHA-256 of output and of the rebuilt text in place of the texts."""
    sql = f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({RESTORED}) AS restored_sha256 FROM batch"
    return in_duckdb(formatted, sql, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")
