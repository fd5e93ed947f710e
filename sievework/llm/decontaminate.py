"""Benchmark decontamination by pigeonhole edit matching.

Texts compare as UTF-8 in lower case and each run of ASCII white space as one space. An item of n bytes may differ from a passage by up to n // BYTES_PER_ERROR edits. Split into one piece more than that, at least one piece of any such passage is exact; all pieces of all items are found in one pass over the whole text. Each hit says where its item would begin; around those places Myers' bit-parallel algorithm measures the edit distance. Items of fewer than SHORT_BYTES have no error budget and count only as whole words. Items go in blocks of about BLOCK_BYTES; each further block is a job of its own over the documents, whose matches are written by the hash of the text before the next begins, so what a task or the driver holds is bounded whatever the benchmark's size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import textscan
from sievework.llm.common import Scratch, bounded_batches, columns, with_small

BYTES_PER_ERROR = 12
SHORT_BYTES = 24  # shorter items, normalised, are found exactly and as whole words only
BLOCK_BYTES = 1 << 20  # of items in one automaton
BROADCAST_MATCHES = 100_000  # texts with matches that are broadcast; more are merged by shuffle
_WORD = frozenset(range(48, 58)) | frozenset(range(97, 123)) | frozenset(range(128, 256))  # bytes of words in lower case
MATCHES = "array<struct<item_id:bigint,start:bigint,stop:bigint,distance:int>>"


def lowered(data: bytes) -> bytes:
    """Lower case, as many bytes; a character whose lower case has another length stays."""
    text = data.decode()
    out = text.lower().encode()
    if len(out) != len(data):
        out = "".join(x if len(x.encode()) == len(c.encode()) else c for c, x in ((c, c.lower()) for c in text)).encode()
    return out


def normalise(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as they compare, and for each its place in the text."""
    data = np.frombuffer(lowered(data.tobytes()), np.uint8)
    space = textscan.WS_BYTES[data]
    keep = np.ones(len(data), dtype=bool)
    if len(data):
        keep[1:] = ~(space[1:] & space[:-1])
        keep[0] = not space[0]
        if keep.any() and space[last := np.flatnonzero(keep)[-1]]:
            keep[last] = False
    at = np.flatnonzero(keep)
    out = data[at]
    out[space[at]] = 32
    return out, at


def errors_of(n: int) -> int:
    """The error budget of an item of n bytes."""
    return n // BYTES_PER_ERROR if n >= SHORT_BYTES else 0


def alone(text: bytes, start: int, stop: int) -> bool:
    """Whether a word neither begins before start nor ends after stop."""
    return not (start > 0 and text[start - 1] in _WORD and text[start] in _WORD or stop < len(text) and text[stop] in _WORD and text[stop - 1] in _WORD)


class Item:
    """An item with its pieces and the bit masks of its bytes."""

    def __init__(self, item_id: int, text: bytes):
        self.item_id, self.text, self.errors = item_id, text, errors_of(len(text))
        edges = [len(text) * i // (self.errors + 1) for i in range(self.errors + 2)]
        self.pieces = [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.masks: dict[int, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def search(self, window: bytes) -> tuple[int, int]:
        """Least edit distance of the item to any part of the window, and the first place where a part so close ends."""
        full = (1 << len(self.text)) - 1
        top = 1 << (len(self.text) - 1)
        plus, minus, score = full, 0, len(self.text)
        best, stop = score, 0
        for at, c in enumerate(window):
            eq = self.masks.get(c, 0)
            vertical = eq | minus
            horizontal = (((eq & plus) + plus) ^ plus) | eq
            up = minus | ~(horizontal | plus) & full
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full
            plus = down | ~(vertical | up) & full
            minus = up & vertical
            if score < best:
                best, stop = score, at + 1
        return best, stop


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, bytes]]):
        import ahocorasick

        self.items, owners = [Item(i, t) for i, t in items], {}
        for k, item in enumerate(self.items):
            for at, piece in item.pieces:
                owners.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), own))
        self.automaton.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, start, stop, distance) of the passages in a normalised text, by item and place."""
        places: dict[int, list[int]] = {}
        if not self.items:
            return []
        for end, (length, own) in self.automaton.iter(text.decode("latin-1")):
            for k, at in own:
                places.setdefault(k, []).append(end + 1 - length - at)
        out = []
        for k, starts in sorted(places.items()):
            item, starts = self.items[k], sorted(set(starts))
            if len(item.text) < SHORT_BYTES:
                stops = ((at, at + len(item.text)) for at in starts)
                out += [(k, at, stop, 0) for at, stop in stops if alone(text, at, stop)]
                continue
            low = high = starts[0]
            for start in [*starts[1:], None]:
                if start is not None and start - high <= 2 * item.errors + 1 and start - low <= len(item.text):
                    high = start
                    continue
                begin = max(0, low - item.errors)
                window = text[begin : high + len(item.text) + item.errors]
                at = window.find(item.text)
                distance, stop = (0, at + len(item.text)) if at >= 0 else item.search(window)
                if distance <= item.errors:
                    out.append((k, max(0, begin + stop - len(item.text)), begin + stop, distance))
                low = high = start
        return out


def _match(batches: Iterator[pa.RecordBatch], items: list[tuple[int, bytes]], every: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose second column is the text, with a further column of matches: every row, or those that have any."""
    matcher = Matcher(items)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("distance", pa.int32())]))
    for batch in batches:
        for low, high, data, offsets in textscan.slices(batch.column(1)):
            found = []
            for d in range(high - low):
                text, at = normalise(data[offsets[d] : offsets[d + 1]])
                found.append([{"item_id": matcher.items[k].item_id, "start": int(at[a]), "stop": int(at[b - 1]) + 1, "distance": e} for k, a, b, e in matcher.find(text.tobytes())])
            keep = pa.array([d for d in range(high - low) if every or found[d]], pa.int64())
            own = [batch.column(i).slice(low, high - low).take(keep) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, kind).take(keep)], names=[*batch.schema.names, "matches"])


def _items(benchmark: DataFrame, block: int, blocks: int) -> list[tuple[int, bytes]]:
    """The normalised items of a block, about BLOCK_BYTES, without empty ones."""
    some = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
    some = ((r[0], normalise(np.frombuffer(r[1].encode(), np.uint8))[0].tobytes()) for r in some)
    return sorted((x for x in some if x[1]), key=lambda x: (x[1], x[0] is None, x[0] or 0))


def decontaminate(docs: DataFrame, benchmark: DataFrame, carry: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, contaminated, matches (item_id, byte range in the text, edit distance). With carry, also text and `carried`, a struct of the other columns, whatever their names.

    benchmark: (item_id, text); null and empty texts match nothing, those of fewer than SHORT_BYTES only exactly and as whole words; of equal items each reports its own. A null or empty document is clean. Texts of any length are searched whole, one at a time beyond a megabyte. Repeated rows and null ids are judged row by row. An empty benchmark leaves everything clean; no rows give no rows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carry_struct = carry and bool(others)
    more = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("carried")] if carry_struct else []
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    keep = ["doc_id", *(["text"] if carry else []), *(["carried"] if carry_struct else [])]
    bounded_batches(docs.sparkSession)
    benchmark = columns(benchmark, "item_id", "text").where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = max(1, -(-(benchmark.select(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES))
    none = F.array().cast(MATCHES)
    if blocks == 1:
        items = _items(benchmark, 0, 1)
        out = out.mapInArrow(lambda batches: _match(batches, items, True), T.StructType([*out.schema.fields, T.StructField("matches", out.select(none).schema[0].dataType)]))
    else:
        scratch = scratch or Scratch(docs.sparkSession, "benchmark")
        key = [F.xxhash64("text").alias("key_a"), F.xxhash64("text", F.lit(1)).alias("key_b")]  # what matches a text depends on nothing else
        texts, found = out.where("text is not null").select(key[0], "text", key[1]), None
        for block in range(blocks):
            items = _items(benchmark, block, blocks)
            if items:
                own = texts.mapInArrow(lambda batches, items=items: _match(batches, items, False), f"key_a long, text string, key_b long, matches {MATCHES}")
                own = own.groupBy("key_a", "key_b").agg(F.first("matches").alias("matches"))  # equal texts match alike
                own = scratch.save(own.withColumn("block", F.lit(block)), f"matches-{block}")
                found = own if found is None else found.union(own)
        found = scratch.save(found.groupBy("key_a", "key_b").agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "matches")))["matches"]).alias("matches")), "matches")  # a text's own
        out = with_small(out.withColumns({"key_a": key[0], "key_b": key[1]}), found, ["key_a", "key_b"], "left", BROADCAST_MATCHES)
    return out.select(*keep, (F.coalesce(F.size("matches"), F.lit(0)) > 0).alias("contaminated"), F.coalesce("matches", none).alias("matches"))
