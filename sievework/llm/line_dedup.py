"""Line dedup against a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least MIN_POINTS code points that at least MIN_DOCS documents hold lose all their lines except those in the largest doc_id that holds them. Keys are known by two independent 64-bit hashes. The distinct keys that more than one document holds (one that a single document holds can't repeat, and needs no slot) are dealt to shards by hash; each shard is a minimal perfect hash (levels of bit arrays with ranks) of the first hash that indexes arrays of the second, of the number of documents (a byte, MOST and more alike) and of the largest id: 17 bytes a key and some 3 bits of hash. Keys that share the first hash are kept in a short list beside it, so two keys are taken for one only if all 128 bits agree. Documents probe those arrays: while they are within BROADCAST_BYTES every task holds them, beyond that documents' hashes go to the shards. A shard goes to as many tasks as its probes fill by PROBES, so what is shuffled follows the probes, and a task streams its probes past one shard. Both ways give the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm import textscan
from sievework.llm.common import Scratch, with_small

MIN_POINTS, MIN_DOCS, MOST = 20, 3, 255
SHARD_KEYS = 250_000  # keys in a shard, about
PROBES = 4_000_000  # probes of one copy of a shard, about, beyond BROADCAST_BYTES
BROADCAST_BYTES = 64 << 20
LEVELS = 48
NO_ID = np.iinfo(np.int64).min  # stands for a null doc_id: below all ids


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines: start, end, text, whether the key is long enough; and of these keys both hashes."""
    starts, ends, doc = textscan.lines(data, offsets)
    lower = textscan.LOWER[data]
    word_starts, word_ends, _ = textscan.words(lower, offsets)
    if not len(word_starts):
        none = np.zeros(0, np.uint64)
        return starts, ends, doc, np.zeros(len(starts), bool), none, none
    first = word_starts[np.minimum(np.searchsorted(word_starts, starts), len(word_starts) - 1)]
    last = word_ends[np.maximum(np.searchsorted(word_ends, ends, side="right") - 1, 0)]
    points = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = (first >= starts) & (first < ends) & (last > first)
    long[long] = points[last[long]] - points[first[long]] >= MIN_POINTS
    return starts, ends, doc, long, *(textscan.hash_spans(lower, first[long], last[long], k) for k in (0, 1))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ...) to a document's distinct long keys, with what follows the text."""
    for batch in batches:
        for low, high, data, offsets in textscan.slices(batch.column(1)):
            _, _, doc, long, a, b = lines(data, offsets)
            owner = doc[long]
            order = np.lexsort((b, a, owner))
            a, b, owner = a[order], b[order], owner[order]
            fresh = np.ones(len(a), dtype=bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
            own = [batch.column(k).slice(low, high - low).take(pa.array(owner[fresh])) for k in (0, *range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(textscan.signed(a[fresh])), pa.array(textscan.signed(b[fresh]))], names=["doc_id", *batch.schema.names[2:], "a", "b"])


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in each level a key that is alone at its bit stays, the others go on."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        counts = np.bitwise_count(words).astype(np.int64)
        self.rank = np.cumsum(counts) - counts

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, parts = keys, [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-max(64, 2 * len(left)) // 64) * 64
            at = cls._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("two keys of a shard have the same 64-bit hash")
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (textscan.mix64(keys ^ textscan.stream64(61, LEVELS)[level]) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of a key that wasn't built in, any slot or -1."""
        out, left, base = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + self._place(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[left[here]] = self.rank[at[here] >> 6] + np.bitwise_count(below)
            left, base = left[~here], base + size
        return out


_ARRAYS = ["sizes", "words", "fingerprints", "counts", "largest", "beside"]
_SHARD = "shard int, " + ", ".join(f"{x} binary" for x in _ARRAYS)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    """A shard's arrays from its keys (shard, a, b, n, largest)."""
    group = group.sort_values(["a", "b"])
    again = group["a"].duplicated().to_numpy()
    main, beside = group[~again], group[again]
    a, b = (main[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("a", "b"))
    index = PerfectHash.build(a)
    slot = index.slots(a)
    put = lambda x: x[np.argsort(slot)].tobytes()
    arrays = [np.array(index.sizes, dtype=np.int64).tobytes(), index.words.tobytes(), put(b), put(np.minimum(main["n"].to_numpy(), MOST).astype(np.uint8)), put(main["largest"].to_numpy(dtype=np.int64)), beside[["a", "b", "n", "largest"]].to_numpy(dtype=np.int64).tobytes()]
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], **{name: [x] for name, x in zip(_ARRAYS, arrays, strict=True)}})


class Shard:
    def __init__(self, sizes: bytes, words: bytes, fingerprints: bytes, counts: bytes, largest: bytes, beside: bytes):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64).tolist(), np.frombuffer(words, np.uint64))
        self.fingerprints, self.counts, self.largest = np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.uint8), np.frombuffer(largest, np.int64)
        self.beside = np.frombuffer(beside, np.int64).reshape(-1, 4)

    def repeated(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether each line goes: its key is one of the shard's, at least MIN_DOCS documents hold it, and another one than this is the largest."""
        slot = self.hash.slots(a)
        found = slot >= 0
        found[found] = self.fingerprints[slot[found]] == b[found]
        found[found] = (self.counts[slot[found]] >= MIN_DOCS) & (self.largest[slot[found]] != ids[found])
        for first, second, n, largest in self.beside:
            if n >= MIN_DOCS:
                found |= (a == first.view(np.uint64)) & (b == second.view(np.uint64)) & (ids != largest)
        return found


def shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def _rewrite(batches: Iterator[pa.RecordBatch], goes) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, carried ...) to the same with the new text, n_lines and n_dropped. goes: says of a run of rows' keys which go."""
    for batch in batches:
        texts = batch.column(1).fill_null("") if batch.column(1).null_count else batch.column(1)
        ids, new, n_lines, n_dropped = _ids(batch.column(0)), {}, [], []
        for low, high, data, offsets in textscan.slices(texts):
            starts, ends, doc, long, a, b = lines(data, offsets)
            gone = np.zeros(len(starts), dtype=bool)
            gone[long] = goes(batch, low, doc[long], a, b, ids[low:high][doc[long]])
            n_lines.append(np.bincount(doc, minlength=high - low))
            n_dropped.append(np.bincount(doc[gone], minlength=high - low))
            at = np.searchsorted(doc, np.arange(high - low + 1))
            for d in np.flatnonzero(n_dropped[-1]):
                stay = at[d] + np.flatnonzero(~gone[at[d] : at[d + 1]])
                new[low + int(d)] = b"\n".join(data[starts[i] : ends[i]].tobytes() for i in stay).decode()
        if new:
            mask = np.zeros(len(texts), dtype=bool)
            mask[list(new)] = True
            texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], texts.type))
        one = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        rest = [batch.column(i) for i in range(2, batch.num_columns) if batch.schema.names[i] != "gone"]
        yield pa.RecordBatch.from_arrays([batch.column(0), texts, *rest, one(n_lines), one(n_dropped)], names=["doc_id", "text", *(n for n in batch.schema.names[2:] if n != "gone"), "n_lines", "n_dropped"])


def key_index(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """The shards over the distinct keys that at least two documents hold (a written table), and how many there are. Rows with a null doc_id aren't counted."""
    keys = docs.select("doc_id", "text").mapInArrow(_keys, "doc_id long, a long, b long")
    often = scratch.save(keys.groupBy("a", "b").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("largest")).where("n > 1"), "often")
    shards = max(1, -(-often.count() // SHARD_KEYS))
    index = often.withColumn("shard", F.pmod(F.shiftrightunsigned("a", 40), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build, _SHARD)
    index = scratch.save(index, "shards")
    scratch.drop("often")
    return index, shards


def _probe_here(index: DataFrame, shards: int):
    """For arrays within BROADCAST_BYTES: each task holds them."""
    sent = index.sparkSession.sparkContext.broadcast({r[0]: tuple(bytes(x) for x in r[1:]) for r in index.collect()})
    opened: dict[int, Shard] = {}

    def goes(_batch, _low, _doc, a, b, ids):
        if not opened:
            opened.update({k: Shard(*v) for k, v in sent.value.items()})
        out, where = np.zeros(len(a), dtype=bool), shard_of(a, shards)
        for k in np.unique(where):
            if int(k) in opened:
                mine = where == k
                out[mine] = opened[int(k)].repeated(a[mine], b[mine], ids[mine])
        return out

    return goes


def _deal(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        to = shard_of(batch.column(2).to_numpy().view(np.uint64), shards)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to.astype(np.int32))], names=["id", "row", "a", "b", "shard"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard and salt, each time the shard first and then its probes (shard, salt, id, row, a, b, arrays), to the (id, row, a) that go."""
    at, shard = None, None
    for batch in batches:
        number, salt, ids, a, b = (batch.column(k).fill_null(0).to_numpy() for k in (0, 1, 2, 4, 5))
        edges = np.flatnonzero((number[1:] != number[:-1]) | (salt[1:] != salt[:-1])) + 1
        for low, high in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if low == high:
                continue
            if (number[low], salt[low]) != at:
                at, shard = (number[low], salt[low]), None
            if batch.column(6)[int(low)].is_valid:
                shard = Shard(*(bytes(x.as_py()) for x in batch.column(6)[int(low)].values()))
                low += 1
            if shard is not None and low < high:
                gone = pa.array(low + np.flatnonzero(shard.repeated(a[low:high].view(np.uint64), b[low:high].view(np.uint64), ids[low:high])))
                yield pa.RecordBatch.from_arrays([batch.column(k).take(gone) for k in (2, 3, 4)], names=["id", "row", "a"])


def _probe_there(docs: DataFrame, index: DataFrame, shards: int, scratch: Scratch, probes: int) -> DataFrame:
    """For larger arrays: documents' keys go to the shards. docs with a further column, the hashes of the keys that go. Rows are known by id and hash of the text, on which alone it depends what goes; so a group is one document's lines, with or without an id."""
    known = [F.coalesce("doc_id", F.lit(int(NO_ID))).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row")]
    keys = docs.select(known[0], "text", known[1]).mapInArrow(_keys, "id long, row long, a long, b long").mapInArrow(lambda batches: _deal(batches, shards), "id long, row long, a long, b long, shard int")
    keys = scratch.save(keys, "probes")
    salts = scratch.save(keys.groupBy("shard").agg(F.ceil(F.count("*") / probes).cast("int").alias("salts")), "salts")
    dealt = with_small(keys, salts, "shard", "inner").select("shard", F.pmod(F.xxhash64("id", "row", "a"), "salts").cast("int").alias("salt"), "id", "row", "a", "b")
    none = F.lit(None).cast(index.select(F.struct(*_ARRAYS)).schema[0].dataType)
    copies = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", *(F.lit(None).cast("long").alias(c) for c in ("id", "row", "a", "b")), F.struct(*_ARRAYS).alias("arrays"))
    both = copies.union(dealt.withColumn("arrays", none)).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
    gone = both.mapInArrow(_probe, "id long, row long, a long")
    gone = scratch.save(gone.groupBy("id", "row").agg(F.collect_set("a").alias("gone")), "gone")  # a document's own lines
    scratch.drop("probes")
    return docs.withColumns({"id": known[0], "row": known[1]}).join(gone, ["id", "row"], "left").select(*docs.columns, "gone")


def _given(batch, low, doc, a, _b, _ids):
    gone = batch.column(batch.schema.get_field_index("gone"))
    out = np.zeros(len(a), dtype=bool)
    for d in np.unique(doc):
        if (hashes := gone[low + int(d)].as_py()) is not None:
            mine = doc == d
            out[mine] = np.isin(a[mine], np.array(hashes, dtype=np.int64).view(np.uint64))
    return out


def dedup_lines(docs: DataFrame, carry: bool = False, scratch: Scratch | None = None, broadcast_bytes: int = BROADCAST_BYTES, probes: int = PROBES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, the new text, n_lines before dropping, n_dropped. With carry, also `carried`, a struct of the other columns, whatever their names; without, they are ignored.

    A null or empty text has one empty line and stays as an empty text. Keys compare whole lines of any length. Documents are counted by distinct doc_id; repeated rows of one doc_id are one document and are rewritten alike. A null doc_id isn't counted and counts as smaller than any, so its repeated lines go. No rows give no rows."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carry = carry and bool(others)
    more = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("carried")] if carry else []
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    schema = T.StructType([*own.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    index, shards = key_index(own, scratch)
    size = index.select(F.sum(F.length("words") + F.length("fingerprints") + F.length("counts") + F.length("largest") + F.length("beside"))).first()[0] or 0
    if size <= broadcast_bytes:
        goes = _probe_here(index, shards)
        return own.mapInArrow(lambda batches: _rewrite(batches, goes), schema)
    return _probe_there(own, index, shards, scratch, probes).mapInArrow(lambda batches: _rewrite(batches, _given), schema)
