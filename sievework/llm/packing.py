"""Packing documents into sequences of bounded length by large-item matching.

Only the histogram of piece lengths, at most `capacity` numbers, meets in one place. The plan is made there in runs: pieces of the same length that get the same place in consecutive sequences. Pieces above a third of the capacity fit at most twice into a sequence: from the longest on, each is matched with the longest other that still fits. Shorter ones, from the longest on, go to the smallest gap that holds them. Each piece has a rank among those of its length, from counts by block and a prefix sum; rank and plan give its sequence and offset without moving any document."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm import tokens
from sievework.llm.common import Scratch, columns, with_small

CAPACITY, END = 2048, 0
BROADCAST_COUNTS = 500_000  # counts by length and block that are broadcast, 24 bytes each; more are merged by shuffle


def cut(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n ids."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId()
    for batch in batches:
        for low, high, ids, offsets in tokens.encoded(batch.column(1), END, path):
            ids = ids.astype("<u4")
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for d in range(high - low):
                at = int(offsets[d])
                for k, n in enumerate(cut(int(offsets[d + 1]) - at, capacity)):
                    row.append(d)
                    piece.append(k)
                    start.append(at - int(offsets[d]))
                    length.append(n)
                    crc.append(crc32(ids[at : at + n]))
                    if with_ids:
                        own.append(ids[at : at + n].tobytes())
                    at += n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([block] * len(row), pa.int32()), *([pa.array(own, pa.binary())] if with_ids else [])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "block", *(["ids"] if with_ids else [])],
            )


class Plan:
    """Runs (length, first rank, count, first sequence, offset) from a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.runs = capacity, 0, []
        self._left, self._used = {k: v for k, v in histogram.items() if v}, dict.fromkeys(histogram, 0)
        self._gaps: list[int] = []  # sorted, of those that have open sequences
        self._open: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, count)
        large = sorted(k for k in self._left if 3 * k > capacity)
        self._match(large)
        for n in sorted((k for k in self._left if 3 * k <= capacity), reverse=True):
            self._fill(n)

    def _take(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self._used[length], count, sequence, offset))
        self._used[length] += count
        self._left[length] -= count

    def _new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _put(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in self._open:
                insort(self._gaps, gap)
            self._open.setdefault(gap, []).append((sequence, count))

    def _match(self, large: list[int]) -> None:
        while large:
            longest = large[-1]
            n = self._left[longest]
            at = bisect_left(large, self.capacity - longest + 1) - 1
            if n == 1 and at >= 0 and large[at] == longest:  # no second of its length: the next shorter
                at -= 1
            other = large[at] if at >= 0 else 0
            pairs = min(n, self._left[other]) if other and other != longest else n // 2 if other else 0
            if pairs:
                sequence = self._new(pairs)
                self._take(longest, pairs, sequence, 0)
                self._take(other, pairs, sequence, longest)
                self._put(self.capacity - longest - other, sequence, pairs)
            else:
                sequence = self._new(n)
                self._take(longest, n, sequence, 0)
                self._put(self.capacity - longest, sequence, n)
            large = [k for k in large if self._left[k]]

    def _fill(self, length: int) -> None:
        while n := self._left[length]:
            at = bisect_left(self._gaps, length)
            if at < len(self._gaps):
                gap = self._gaps[at]
                sequence, count = self._open[gap].pop()
                if not self._open[gap]:
                    del self._open[gap], self._gaps[at]
            else:
                gap = self.capacity
                count = -(-n // (gap // length))
                sequence = self._new(count)
            each = min(gap // length, n)
            full = min(count, n // each)
            for k in range(each):
                self._take(length, full, sequence, self.capacity - gap + k * length)
            self._put(gap - each * length, sequence, full)
            if full < count:
                if rest := min(self._left[length], each):
                    for k in range(rest):
                        self._take(length, 1, sequence + full, self.capacity - gap + k * length)
                    self._put(gap - rest * length, sequence + full, 1)
                    full += 1
                self._put(gap, sequence + full, count - full)

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys length << 40 | first rank, first ranks, first sequences, offsets."""
        r = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return r[:, 0] << 40 | r[:, 1], r[:, 1], r[:, 3], r[:, 4]


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds `ids`, little-endian unsigned 32-bit.

    Ids are the library's by default, so that the string of a special token in a text is that token. Further columns are ignored, whatever their names. Texts of any length are encoded whole. Only documents of more than `capacity` ids (the end id counts) are cut; all pieces but the first are of full length. A null or empty text has the end id alone. Repeated rows, and rows with a null doc_id, are packed one by one. Pieces of equal length rank by block, doc_id and piece. No rows give no rows. Sequence numbers start at 0; each sequence is filled from offset 0 without gaps."""
    scratch = scratch or Scratch(docs.sparkSession, "pack")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block int" + ", ids binary" * with_ids
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.save(own.mapInArrow(lambda batches: _pieces(batches, path, capacity, with_ids), schema), "pieces")
    counts = scratch.save(pieces.groupBy("length", "block").agg(F.count("*").alias("n")), "counts")
    plan = Plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}, capacity).places()  # at most `capacity` numbers
    before = scratch.save(counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before")), "before")
    rank = F.row_number().over(Window.partitionBy("block", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = with_small(pieces.withColumn("rank", rank.cast("long")), before, ["length", "block"], "inner", BROADCAST_COUNTS).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else []))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = plan
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            run = np.searchsorted(keys, length << 40 | rank, side="right") - 1
            rest = batch.columns[6:]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[run] + rank - first[run]), pa.array(offset[run]), *rest], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * with_ids)
