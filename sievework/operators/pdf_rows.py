"""The streams of PDFs as rows: a table function opens them, joins and windows do the rest."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.rewriting import streams_of

STREAM = "stream: bigint, place: bigint, stored_bytes: bigint, depth: bigint, cut: boolean, bomb: boolean, inflated: binary, stream_error: string"


@F.udtf(returnType=STREAM)
class PdfStreams:
    """A row for each stream of one PDF's bytes; one with an error alone if it can't be read further."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        try:
            for row in streams_of(bytes(content or b"")):
                yield *row, None
        except (ValueError, OverflowError, IndexError) as broken:  # a malformed file; anything else, as memory running out, fails the task
            yield *(None,) * 7, f"{type(broken).__name__}: {broken}"


def stream_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, joined with the rows of their streams; files without a stream have none."""
    own = [c for c in files.columns if c != content]
    return files.lateralJoin(PdfStreams(F.col(content).outer())).select(*own, *(x.split(":")[0] for x in STREAM.split(", ")))


def spans(streams: DataFrame, key: str) -> DataFrame:
    """key, stream, start and length of each opened stream in its file's streams joined with a byte after each."""
    before = Window.partitionBy(key).orderBy("stream").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("inflated").cast("long")
    return streams.where("inflated IS NOT NULL").select(key, "stream", F.coalesce(F.sum(size + 1).over(before), F.lit(0)).alias("start"), size.alias("length"))


def joined(streams: DataFrame, key: str) -> DataFrame:
    """key and `inflated`, a file's opened streams in order with a line feed after each. The table function's limit bounds a file's total."""
    whole = F.expr("listagg(inflated, X'0A') WITHIN GROUP (ORDER BY stream)")
    return streams.where("inflated IS NOT NULL").groupBy(key).agg(F.concat(whole, F.lit(b"\n")).alias("inflated"))
