"""Token counts of documents in flat token files by a separator scan.

A flat file is nothing but 16-bit ids, each document closed by the end id; there is no index. Files are read as blocks. In each block a vectorised comparison finds the end ids; what a block says of itself is a few numbers: its ids, its ends, the place of the last one, and the distances between them. An exclusive prefix scan over the blocks of a file, in two levels so that no task holds more than a chunk of summaries, gives each block the number of ends before it and the place of the last; that closes the document that runs into the block, however many blocks it spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sievework.llm import tokens
from sievework.llm.common import Scratch, columns

END = 50256
BLOCK = 1 << 16  # ids in a block
CHUNK = 512  # blocks that are scanned together


def _files(batches: Iterator[pa.RecordBatch], path: str | None, block: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to this partition's flat file, in blocks, and its list of documents: kind 0 and 1."""
    file, no, kept, listed = TaskContext.get().partitionId(), 0, np.zeros(0, "<u2"), 0
    names = ["kind", "file", "no", "data", "doc_ids"]

    def rows(kind: int, first: int, data: list, ids: list) -> pa.RecordBatch:
        n = len(data)
        return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([file] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(data, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=names)

    for batch in batches:
        for low, high, ids, _ in tokens.encoded(batch.column(1), END, path, special=False):  # no text can hold the end id
            kept = np.concatenate([kept, ids.astype("<u2")])
            whole = len(kept) // block
            if whole:
                yield rows(0, no, [kept[i * block : (i + 1) * block].tobytes() for i in range(whole)], [None] * whole)
                no, kept = no + whole, kept[whole * block :].copy()
            one = rows(1, listed, [None], [batch.column(0).slice(low, high - low).to_pylist()])
            listed += high - low
            yield one
    if len(kept):
        yield rows(0, no, [kept.tobytes()], [None])


def write_flat(docs: DataFrame, scratch: Scratch, path: str | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Tokenises docs (doc_id, text) to a flat file a partition. Gives the files' blocks (file, block, data), and which document is which in each file (file, ordinal, doc_id)."""
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(lambda batches: _files(batches, path, block), "kind int, file long, no long, data binary, doc_ids array<long>")
    at = f"{scratch.root}/flat"
    out.write.partitionBy("kind").option("compression", "zstd").parquet(at)
    saved = docs.sparkSession.read.schema("file long, no long, data binary, doc_ids array<long>, kind int").parquet(at)
    documents = saved.where("kind = 1").select("file", "no", F.posexplode("doc_ids").alias("k", "doc_id")).select("file", (F.col("no") + F.col("k")).alias("ordinal"), "doc_id")
    return saved.where("kind = 0").select("file", F.col("no").alias("block"), "data"), documents


def _scan(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    """(file, block, data) to (file, block, ids, ends, first, last, inner): places of the first and last end id, and the lengths of documents between ends."""
    for batch in batches:
        sizes, counts, firsts, lasts, inner = [], [], [], [], []
        for data in batch.column(2):
            ids = np.frombuffer(data.as_buffer() if data.is_valid else b"", dtype="<u2")
            ends = np.flatnonzero(ids == end)
            sizes.append(len(ids))
            counts.append(len(ends))
            firsts.append(int(ends[0]) if len(ends) else None)
            lasts.append(int(ends[-1]) if len(ends) else None)
            inner.append((np.diff(ends) - 1).tolist())
        long = lambda x: pa.array(x, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(sizes), long(counts), long(firsts), long(lasts), pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "ids", "ends", "first", "last", "inner"])


def count_tokens(blocks: DataFrame, scratch: Scratch, end: int = END) -> DataFrame:
    """One row per document of the flat files whose blocks these are (file, block, data): file, ordinal, n_tokens (without the end id), closed.

    Blocks of a file are numbered in order, of any length; a null or empty block has no ids. Ids after a file's last end are one more document that isn't closed. Two ends next to each other close an empty document. No blocks give no rows."""
    own = columns(blocks, "file", "block", "data")
    schema = T.StructType([*own.schema.fields[:2], *(T.StructField(c, T.LongType()) for c in ("ids", "ends", "first", "last")), T.StructField("inner", T.ArrayType(T.LongType()))])
    seen = scratch.save(own.mapInArrow(lambda batches: _scan(batches, end), schema), "blocks")
    seen = seen.withColumn("chunk", F.floor(F.col("block") / CHUNK))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    inside = earlier("file", "chunk", "block")
    seen = seen.withColumn("at", zero("ids", inside)).withColumn("ordinal", zero("ends", inside)).withColumn("stop", F.max(F.col("at") + F.col("last")).over(inside))
    chunks = seen.groupBy("file", "chunk").agg(F.sum("ids").alias("ids"), F.sum("ends").alias("ends"), F.max(F.col("at") + F.col("last")).alias("last"))
    over = earlier("file", "chunk")
    chunks = chunks.withColumn("chunk_at", zero("ids", over)).withColumn("chunk_ordinal", zero("ends", over))
    chunks = chunks.withColumn("chunk_stop", F.max(F.col("chunk_at") + F.col("last")).over(over)).select("file", "chunk", "chunk_at", "chunk_ordinal", "chunk_stop")
    seen = seen.join(chunks, ["file", "chunk"])
    at, stop = F.col("chunk_at") + F.col("at"), F.coalesce(F.col("chunk_at") + F.col("stop"), F.col("chunk_stop"), F.lit(-1))
    lengths = F.concat(F.array(at + F.col("first") - stop - 1), F.col("inner"))
    ends = seen.where("ends > 0").select("file", (F.col("chunk_ordinal") + F.col("ordinal")).alias("base"), F.posexplode(lengths).alias("k", "n_tokens"))
    closed = ends.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    tail = seen.groupBy("file").agg(F.sum("ids").alias("ids"), F.sum("ends").alias("ordinal"), F.max(F.col("chunk_at") + F.col("at") + F.col("last")).alias("last"))
    tail = tail.select("file", "ordinal", (F.col("ids") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(tail)


def document_token_counts(docs: DataFrame, path: str | None = None, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and n_tokens for each row of docs (doc_id, text): written as flat files, then counted by the scan alone.

    A null or empty text has no tokens. A text of any length may span any number of blocks. The string of the end token in a text is ordinary text. Repeated rows and null ids each have their row. No rows give no rows. Further columns are ignored."""
    scratch = scratch or Scratch(docs.sparkSession, "flat")
    blocks, documents = write_flat(docs, scratch, path, block)
    return count_tokens(blocks, scratch).join(documents, ["file", "ordinal"]).select("doc_id", "n_tokens")
