"""Submissions: one row a file, with its untrusted name, declared type and category, and its content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.dialect import Spark

_PDF, _SVG = "%PDF-1.7 ", "<svg xmlns=\"http://www.w3.org/2000/svg\""
#: Payload prefixes by doc_id % 13.
PREFIXES = {
    0: "''",
    1: f"'{_PDF}/OpenAction /JavaScript '",
    2: f"'{_SVG} onload=\"x()\"> '",
    3: "'<!-- <svg --><html> '",
    4: "'GIF89a<?php system($_GET[0]); eval($_POST[1]); ?> '",
    5: f"'{_PDF}/Names /JavaScript '",
    6: f"repeat(' ', 1030) || '{_PDF}/Launch '",
    7: f"'{_PDF}/URI (javascript:alert(1)) '",
    8: f"'{_PDF}Profile: x '",
    9: f"'{_PDF}(https://Evil.Example.COM:8443/a) (http://purl.org/dc/) '",
    10: "'BMxx MZ '",
    11: "'<!DOCTYPE a [<!ENTITY b SYSTEM \"file:///etc/passwd\">]> '",
    12: "'ab'",
}
#: File names by doc_id % 16.
NAMES = {
    0: "'photo' || doc_id || '.jpg'",
    1: "'photo' || doc_id || '.png'",
    2: "'photo' || doc_id || '.webp'",
    3: "'drawing' || doc_id || '.svg'",
    4: "'paper' || doc_id || '.pdf'",
    5: "'PAPER' || doc_id || '.PDF'",
    6: "doc_id || '_shell.php.jpg'",
    7: "doc_id || '_holiday.2024.jpg'",
    8: "'noextension' || doc_id",
    9: "'dot' || doc_id || '.'",
    10: "'.svg'",
    11: "'pad' || doc_id || ' .png'",
    12: "'setup' || doc_id || '.exe'",
    13: "'paper' || doc_id || '.pdf.sample.SAMPLE'",
    14: "'ctl' || chr(1) || doc_id || '.pdf'",
    15: "''",
}


def submissions_sql(d: Spark, documents: str = "documents", labels: str = "labels") -> str:
    """The derived view over documents and labels (names of tables, or fields of a formatted statement): id, truth, category, declared_type, file_name, payload."""
    case = lambda x, table: f"CASE {x} " + " ".join(f"WHEN {k} THEN {v}" for k, v in table.items()) + " END"
    fitting = "CASE WHEN doc_id % 13 IN (1, 5, 6, 7, 8, 9) THEN 'application/pdf' WHEN doc_id % 13 = 2 THEN 'image/svg+xml' WHEN doc_id % 13 = 3 THEN 'image/svg+xml; charset=utf-8' ELSE 'image/jpeg' END"
    step = d.div("doc_id", "3") + " % 7"
    return f"""SELECT doc_id AS id, CASE toxic WHEN 1 THEN 'malicious' WHEN 0 THEN 'clean' END AS truth,
  CASE WHEN {d.div('doc_id', '16')} % 5 IN (0, 1) THEN 'profile' WHEN {d.div('doc_id', '16')} % 5 IN (2, 3) THEN 'id' ELSE 'other' END AS category,
  CASE WHEN {step} <= 3 THEN {fitting} WHEN {step} = 4 THEN 'image/jpg' WHEN {step} = 5 THEN '' ELSE 'application/octet-stream' END AS declared_type,
  {case('doc_id % 16', NAMES)} AS file_name,
  {case('doc_id % 13', PREFIXES)} || coalesce(text, '') AS payload
FROM (SELECT d.doc_id, d.text, l.toxic FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id) AS base"""


def declared_type(name) -> F.Column:
    """The content type that a name's extension stands for."""
    from sievework.functions.tables import DECLARED_BY_EXTENSION

    ext = F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in DECLARED_BY_EXTENSION.items() for x in kv))
    return F.coalesce(F.try_element_at(known, ext), F.lit("application/octet-stream"))


def as_text(df: DataFrame) -> DataFrame:
    """Adds what the predicates work on: t, the content with one character a byte, low, the same in lower case, and raw, the bytes."""
    return df.withColumn("t", F.decode("content", "ISO-8859-1")).withColumn("low", F.lower("t")).withColumn("raw", F.col("content"))
