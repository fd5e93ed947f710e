"""Near duplicates by SetSketch registers.

A document is the set of its distinct shingles of five words. Documents with the same set are one class from the start, so that even a third of all rows being one text costs one partial sum. Each class gets a SetSketch: register i is the smallest of the shingles' exponential hash values, taken as the floor of its logarithm to base b and truncated to 0 ... q + 1. Registers of a union are the maxima of the registers, and two registers are equal with a probability of about the Jaccard similarity. Bands of four registers are the keys of buckets, and the registers' lowest four bits are a signature that rows of shared buckets carry along, as bit planes.

Only bucket keys that several classes share go on. In such a bucket each class is a candidate of two hubs, the smallest id and the smallest set. Candidates whose sizes or signatures differ too much go at once. For the rest similarity is estimated jointly from the counts of larger, smaller and equal registers and the known set sizes by maximum likelihood; candidates whose likelihood at the threshold is hopeless go. What remains is verified on the full sets of the whole texts, which are hashed once more and written for the classes of shared buckets alone. Then a class outside its bucket's largest component is a candidate of one of that component's classes. So candidates are at most three times the rows of buckets, however large one bucket is.

Classes of buckets that then still hold several components, though not all their pairs were candidates, are joined exactly: by the shingles of their prefixes, rarest first, of length n - ceil(0.75 n) + 1, one of which any two similar sets share, the smaller set's within its first seventh. Only postings outside a shingle's largest component meet the others, so that a large group that is one component already costs nothing. Those pairs are all verified; none is left out by rank, run or signature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textscan
from sievework.llm.common import BROADCAST_IDS, Scratch, columns, with_ids
from sievework.llm.components import components

WIDTH = 5  # words in a shingle
PERCENT = 75  # least similarity of linked documents
BANDS, ROWS = 32, 4  # a pair at the threshold shares no band with probability 5e-6
BASE, RATE, TOP = 1.02, 20.0, 65534  # b, a and q of the sketch
PLANES = [f"{half}{k}" for half in "ab" for k in range(4)]  # bits k of the registers' first and second half
AGREE = 72  # least number of the BANDS * ROWS registers whose lowest four bits are equal; fewer has a probability of 1e-7 at the threshold
HOPELESS = 12.0  # log-likelihood ratio beyond which a candidate goes unverified
SLOTS = 1 << 20  # counters of shingles by hash, which give the order of prefixes; any order is exact

_ODD = textscan.stream64(41, BANDS * ROWS) | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their sets: first row, row after the last, flat sorted shingle hashes, offsets."""
    for low, high, data, offsets in textscan.slices(texts):
        data = textscan.LOWER[data]
        starts, ends, first = textscan.words(data, offsets)
        flat, at = textscan.shingles(textscan.hash_spans(data, starts, ends), first, width)
        yield low, high, flat, at


def registers(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SetSketch registers of each non-empty set, uint16 [sets, BANDS * ROWS]; zeros for empty ones."""
    n = len(offsets) - 1
    out = np.zeros((n, len(_ODD)), dtype=np.uint16)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        for i, odd in enumerate(_ODD):
            least = np.minimum.reduceat(flat * odd, offsets[full])
            exponential = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64.0000001) / RATE
            out[full, i] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP + 1)
    return out


_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, registers binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = textscan.stream64(43, 2)
    for batch in batches:
        for low, high, flat, at in shingle_sets(batch.column(1)):
            n, full = high - low, np.flatnonzero(np.diff(at))
            sums = np.zeros((2, n), dtype=np.uint64)
            if len(full):
                for k in range(2):
                    sums[k, full] = np.add.reduceat(textscan.mix64(flat ^ salt[k]), at[full])
            regs = registers(flat, at)
            own = [pa.array(np.diff(at)), *(pa.array(textscan.signed(x)) for x in sums), textscan.binaries(regs.reshape(-1), np.arange(n + 1) * regs.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), *own], names=[x.split()[0] for x in _SKETCH.split(", ")])


def _planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, registers) to the same with PLANES."""
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, BANDS * ROWS)
        bits = [np.packbits(regs >> k & 1, axis=1).view(np.int64) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(bits[k][:, half])) for half in (0, 1) for k in range(4))], names=[*batch.schema.names, *PLANES])


def _log_equal(u: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logarithms of the probabilities that one register is larger, smaller or equal, for size share u and similarity j."""
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - (1 - u) * j), p((1 - u) - u * j)
    return np.log(more), np.log(less), np.log(np.clip(1 - more - less, 1e-9, 1))


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, ra, rb) to (a, b, estimate) of those that the likelihood leaves."""
    grid = np.linspace(0.005, 0.999, 100)
    for batch in (b.slice(low, 2000) for b in batches for low in range(0, b.num_rows, 2000)):
        na, nb = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for i in (4, 5))
        larger, smaller = (x > y).sum(1), (x < y).sum(1)
        equal = x.shape[1] - larger - smaller
        u = (na / (na + nb))[:, None]
        most = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)  # similarity can't be above the ratio of the sizes
        j = np.minimum(grid[None, :], most)
        a, b, c = _log_equal(u, j)
        score = larger[:, None] * a + smaller[:, None] * b + equal[:, None] * c
        near = np.where(j >= PERCENT / 100 - 1e-9, score, -np.inf).max(1)
        keep = np.flatnonzero(near >= score.max(1) - HOPELESS)
        best = j[np.arange(len(j)), score.argmax(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(best[keep])], names=["a", "b", "estimate"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, shingles), the sorted hashes of each set as one binary."""
    for batch in batches:
        for low, high, flat, at in shingle_sets(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), textscan.binaries(flat, at)], names=["doc_id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) to the (a, b) whose full sets are similar enough, one pair at a time."""
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
            common = len(np.intersect1d(x, y, assume_unique=True))
            if common and 100 * common >= PERCENT * (len(x) + len(y) - common):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], names=["a", "b"])


def _slots(flat: np.ndarray) -> np.ndarray:
    return (textscan.mix64(flat) % np.uint64(SLOTS)).astype(np.int64)


def _opened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a column of sets, and the size of each set."""
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array([len(x) for x in parts], dtype=np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingles) to (slot, n): how many shingles fall on each counter."""
    for batch in batches:
        slot, n = np.unique(_slots(_opened(batch.column(0))[0]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], names=["slot", "n"])


def _counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all the sets fall on each counter; SLOTS rows at most come to the driver."""
    slots = sets.select("shingles").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.int32)
    counts[slots.column(0).to_numpy()] = np.minimum(slots.column(1).to_numpy(), 2**31 - 1)
    return counts


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, component, shingles) to the shingles of each prefix, rarest first: doc_id, component, n, place, shingle, and the one before it."""
    for batch in batches:
        flat, n = _opened(batch.column(2))
        doc, size = np.repeat(np.arange(len(n)), n), np.repeat(n, n)
        flat = flat[np.lexsort((flat, counts[_slots(flat)], doc))]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        keep = np.flatnonzero(place <= size - (PERCENT * size + 99) // 100)
        own, before = pa.array(doc[keep]), np.concatenate([flat[:1], flat[:-1]])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(size[keep]), pa.array(place[keep]), pa.array(textscan.signed(flat[keep])), pa.array(textscan.signed(before[keep]))], names=["doc_id", "component", "n", "place", "shingle", "before"])


def _alike(x: str, y: str) -> str:
    """SQL: whether sizes and signatures of x and y leave a chance."""
    unlike = lambda half: "bit_count(" + " | ".join(f"({x}.{half}{k} ^ {y}.{half}{k})" for k in range(4)) + ")"
    sizes = f"100 * least({x}.n_shingles, {y}.n_shingles) >= {PERCENT} * greatest({x}.n_shingles, {y}.n_shingles)"
    return f"{sizes} and {unlike('a')} + {unlike('b')} <= {BANDS * ROWS - AGREE}"


def _buckets(classes: DataFrame) -> DataFrame:
    """(doc_id, bucket), a row for each band of a class."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    return classes.select("doc_id", F.explode(keys).alias("bucket"))


def _members(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The classes in buckets with more than one class (doc_id, n_shingles, registers, PLANES), and the rows (bucket, c) of these buckets; c is the class with its size and signature."""
    shared = scratch.save(_buckets(classes).groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket"), "shared")
    rows = scratch.save(with_ids(_buckets(classes), shared, on="bucket"), "rows")
    inside = scratch.save(rows.select("doc_id").distinct(), "inside")
    schema = "doc_id long, n_shingles long, registers binary, " + ", ".join(f"{x} long" for x in PLANES)
    full = scratch.save(with_ids(classes.select("doc_id", "n_shingles", "registers"), inside).mapInArrow(_planes, schema), "inside-full")
    return full, scratch.save(rows.join(full.drop("registers"), "doc_id").select("bucket", F.struct("doc_id", "n_shingles", *PLANES).alias("c")), "members")


def _pairs(both: DataFrame) -> DataFrame:
    """(a, b), a < b, of rows (c, h) that are alike."""
    both = both.where("c.doc_id <> h.doc_id").where(_alike("c", "h"))
    return both.select(F.expr("least(c.doc_id, h.doc_id) as a"), F.expr("greatest(c.doc_id, h.doc_id) as b")).distinct()


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Pairs of classes and the hubs of their buckets: the smallest id and the smallest set."""
    hubs = members.groupBy("bucket").agg(F.min("c").alias("first"), F.min_by("c", F.struct("c.n_shingles", "c.doc_id")).alias("least"))
    return _pairs(members.join(hubs, "bucket").select("c", F.explode(F.array("first", "least")).alias("h")))


def _component_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of classes outside their bucket's largest component and one class of it."""
    of = found.select(F.col("node").alias("doc_id"), F.col("component"))
    rows = members.withColumn("doc_id", F.col("c.doc_id")).join(of, "doc_id", "left").select("bucket", "c", F.coalesce("component", "doc_id").alias("component"))
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.min_by("c", F.xxhash64("c.doc_id", "bucket")).alias("h"))
    main = sizes.groupBy("bucket").agg(F.max_by(F.struct("component", "h"), F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.count("*").alias("several"))
    main = main.where("several > 1 and size > 3").select("bucket", "main.h", F.col("main.component").alias("largest"))
    return _pairs(rows.join(main, "bucket").where("component <> largest").select("c", "h"))


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, component) of the classes of buckets that hold several components and whose pairs weren't all candidates of hubs: those with more classes than hubs and one."""
    of = found.select(F.col("node").alias("doc_id"), F.col("component"))
    rows = members.select("bucket", F.col("c.doc_id").alias("doc_id"), F.col("c.n_shingles").alias("n")).join(of, "doc_id", "left")
    rows = rows.select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    ends = rows.groupBy("bucket").agg(
        F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("first"), F.min(F.struct("n", "doc_id")).alias("least")
    )
    mixed = ends.where("low < high and size > if(first = least.doc_id, 2, 3)").select("bucket")
    return rows.join(mixed, "bucket", "left_semi").select("doc_id", "component").distinct()


def _prefix_pairs(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b), a < b, of different components that share a shingle of their prefixes, where what follows it still suffices: for a similar pair it does at the first that they share. Then the smaller set has it in its first seventh. Of shingles that both have one after the other only the first makes a row."""
    sizes = prefixes.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("several")).where("several > 1").drop("several")
    rows = scratch.save(prefixes.join(main, "shingle"), "postings")
    early, outside = rows.where("7 * place <= n"), F.expr("component <> main")
    enough = lambda s: f"{100 + PERCENT} * ({s}.n - {s}.place) >= {PERCENT} * (x.n + y.n)"
    on = F.expr(f"x.shingle = y.shingle and x.component <> y.component and (x.n < y.n or x.n = y.n and x.doc_id < y.doc_id) and {enough('x')} and {enough('y')} and not (x.place > 0 and y.place > 0 and x.before = y.before)")
    pairs = [x.alias("x").join(y.alias("y"), on).select(F.expr("least(x.doc_id, y.doc_id) as a"), F.expr("greatest(x.doc_id, y.doc_id) as b")) for x, y in ((early.where(outside), rows), (early.where(~outside), rows.where(outside)))]
    return pairs[0].union(pairs[1]).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text; further columns are ignored, whatever their names): doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased. Documents with 100 * intersection >= 75 * union of their sets are linked; component_id is the smallest doc_id reached. A null text, one without words or an empty one has no shingles and is linked with nothing. Texts of any length count whole; a task holds one at a time. Rows of one doc_id are one document: their texts are linked, and those with shingles stay or go together; n_shingles is each row's own. A null doc_id is linked with nothing, has a null component and is kept. No rows give no rows."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near")
    docs = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = scratch.save(docs.mapInArrow(_sketch, _SKETCH), "sketches")
    key = ["set_a", "set_b", "n_shingles"]
    real = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(real.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("registers").alias("registers")), "classes")
    registers, members = _members(classes, scratch)
    sets = scratch.save(with_ids(docs, registers.select("doc_id").distinct()).mapInArrow(_sets, "doc_id long, shingles binary"), "sets")

    def likely(pairs: DataFrame) -> DataFrame:
        side = lambda x: registers.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
        return pairs.mapInArrow(_estimate, "a long, b long, estimate double").select("a", "b").distinct()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.save(pairs, f"asked-{name}")
        full = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
        both = pairs.join(full("b"), "b").join(full("a"), "a").select("a", "b", "set_a", "set_b")
        return scratch.save(both.mapInArrow(_verify, "a long, b long").distinct(), f"links-{name}")

    def joined(found: DataFrame, links: DataFrame, name: str) -> DataFrame:
        if links.isEmpty():
            return found
        return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), scratch, f"components-{name}")

    # texts of one doc_id are one document
    several = real.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("low"), F.max(F.struct(*key)).alias("high")).where("low <> high").select("doc_id")
    several = scratch.save(several, "several")
    own = with_ids(real, several).select("doc_id", *key).join(classes.select(*key, F.col("doc_id").alias("b")), key).select(F.col("doc_id").alias("a"), "b")
    found = components(verified(likely(_hub_pairs(members)), "hubs").union(own), scratch, "components-hubs")
    found = joined(found, verified(likely(_component_pairs(members, found)), "main"), "main")
    mixed = scratch.save(_mixed(members, found), "mixed")
    n = mixed.count()
    if n:
        few = sets.join(F.broadcast(mixed) if n <= BROADCAST_IDS else mixed, "doc_id").select("doc_id", "component", "shingles")
        sent = spark.sparkContext.broadcast(_counts(few))
        prefixes = scratch.save(few.mapInArrow(lambda batches: _prefixes(batches, sent.value), "doc_id long, component long, n long, place long, shingle long, before long"), "prefixes")
        found = joined(found, verified(_prefix_pairs(prefixes, scratch), "exact"), "exact")

    scratch.retain("sketches", "classes", *(n for n in scratch.names if n.startswith("components-")))
    named = classes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").where("copies > 1 or component is not null").select(*key, F.coalesce("component", "doc_id").alias("component"))
    return (
        sketches.drop("registers")
        .join(named, key, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
