"""Quality classifier from weak labels.

Heuristic labellers vote on two questions, whether a document is junk and whether it is toxic. Those of junk are measures of shape. Those of toxicity are learnt, each from one part of FIT_ROWS labelled documents: they count words that, or whose beginnings, are far more frequent in toxic documents than in others; no word list is built in. A labeller abstains on the documents that it learnt from, and what the scorer sees of its count there is the mean of the others'. Where the labels table says something, that is one more vote. One pass over the corpus gives each document its votes and its features. The votes of all documents are counted by pattern, so what expectation-maximisation sees is at most three to the number of labellers counts, whatever the corpus. It estimates each labeller's rates of calling bad what is bad and what is good, without taking any of them for the truth, and gives each pattern its posterior. On FIT_ROWS documents, the least by hash of their id, the posteriors train a logistic scorer over hashed words, word beginnings and binned shape measures; that scorer judges every document from the features that the pass has written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textscan
from sievework.llm.common import Scratch, columns, with_ids

FIT_ROWS = 10_000  # the bound of what the scorer is fitted on, and of the labelled documents that word lists are learnt from
BITS = 22  # of hashed features; the lowest is 1 for word beginnings
LEAST_DOCS = 12  # documents of the fit that have a feature, else it has no weight
THRESHOLD = 0.5
JUNK = ["symbols", "dup_lines", "repeats", "distinct", "word_length"]
TOXIC = ["learnt_1", "learnt_2", "learnt_3"]
STEMS = (4, 5, 6, 7)  # bytes of word beginnings
LEARNT_DOCS, LEARNT_LIFT = 6, 10  # a learnt word is in so many toxic documents of its part, and so many times as frequent in them
GOOD, BAD, NONE = 0, 1, 2

_APART = np.ones(256, dtype=bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.int32)
    np.cumsum(x, out=out[1:])
    return out


def measures(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: first row, row after the last, shape measures [rows, 6], the row of each word, and hashed features [1 + STEMS, words] of the word and its beginnings, -1 where it is no longer than that."""
    for low, high, data, offsets in textscan.slices(texts):
        rows, lower = high - low, textscan.LOWER[data]
        starts, ends, first = textscan.words(lower, offsets)
        hashes, per = textscan.hash_spans(lower, starts, ends), np.diff(first)
        own, n = np.repeat(np.arange(rows), per), np.maximum(1, per)
        windows = np.zeros(max(0, len(hashes) - 4), dtype=np.uint64)
        for j, factor in enumerate(textscan.stream64(23, 5)):
            windows += hashes[j : j + len(windows)] * factor
        inside = np.flatnonzero(own[: len(windows)] == own[4:]) if len(windows) else np.zeros(0, np.int64)
        line_starts, line_ends, line_doc = textscan.lines(data, offsets)
        said = np.flatnonzero(np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends))
        n_lines = np.bincount(line_doc[said], minlength=rows)
        points, symbols = _running((data & 0xC0) != 0x80), _running(_SYMBOLS[data])
        letters = _running(points[ends] - points[starts])
        shape = np.stack(
            [
                per,
                np.diff(symbols[offsets]) / n,
                1 - textscan.distinct(line_doc[said], textscan.hash_spans(data, line_starts[said], line_ends[said]), rows) / np.maximum(1, n_lines),
                np.where(per >= 10, 1 - textscan.distinct(own[inside], textscan.mix64(windows[inside]), rows) / np.maximum(1, per - 4), 0),
                textscan.distinct(own, hashes, rows) / n,
                np.diff(letters[first]) / n,
            ],
            axis=1,
        )
        shape[n_lines == 0, 2] = 0
        starts, ends, first = textscan.words(lower, offsets, _APART)
        heads = textscan.hash_heads(lower, starts, ends, STEMS)
        features = np.empty(heads.shape, dtype=np.int32)
        features[0] = (heads[0] >> np.uint64(64 - BITS)).astype(np.int32) & ~1
        for k, n in enumerate(STEMS, 1):
            features[k] = np.where(ends - starts > n, (textscan.mix64(heads[k] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32) | 1, -1)
        yield low, high, shape, np.repeat(np.arange(rows), np.diff(first)), features


def votes(shape: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """[rows, labellers of JUNK and TOXIC] of GOOD, BAD or NONE. learnt: [rows, TOXIC] how many learnt words each row has; NaN abstains."""
    n, symbols, dup, repeats, distinct, length = shape.T
    ask = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    enough = n >= 10
    return np.stack(
        [
            ask(symbols > 0.1, symbols == 0),
            ask((dup > 0.3) & enough, dup == 0),
            ask((repeats > 0.15) & enough, repeats < 0.02),
            ask((distinct < 0.45) & enough, distinct > 0.6),
            ask(((length > 6.5) | (length < 3.5)) & enough, (length > 4.2) & (length < 6)),
            *(ask(x > 1, x == 0) for x in learnt.T),
        ],
        axis=1,
    )


#: By place among the measures, the learnt counts after them and their mean share of the words, the edges of bins.
_EDGES = [
    (1, (0.01, 0.05, 0.1, 0.3, 0.6, 1.0)), (2, (0.1, 0.2, 0.3, 0.5)), (3, (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)), (4, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6)), (5, (3.5, 4.2, 5.5, 6.0, 6.5, 7.5)),
    (6, (1, 2, 3, 5)), (7, (1, 2, 3, 5)), (8, (1, 2, 3, 5)), (9, (0.0005, 0.002, 0.005, 0.01, 0.03)),
]


_BASES = np.cumsum([0, *(len(edges) + 1 for _, edges in _EDGES)])


def bins(shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and numbers of the bins of measures and learnt counts; those of shape only for ten words or more."""
    owners, numbers = [], []
    for base, (k, edges) in zip(_BASES, _EDGES, strict=False):
        rows = np.arange(len(shape)) if k > 5 else np.flatnonzero(shape[:, 0] >= 10)
        owners.append(rows)
        numbers.append(base + np.searchsorted(edges, shape[rows, k], side="right"))
    return np.concatenate(owners), np.concatenate(numbers).astype(np.int32)


def learnt_counts(owners: np.ndarray, features: np.ndarray, rows: int, lists: list[np.ndarray]) -> np.ndarray:
    """[rows, TOXIC] how many different words with a learnt feature each row has."""
    out = np.empty((rows, len(TOXIC)))
    for k, known in enumerate(lists):
        here = np.zeros((1 << BITS) + 1, dtype=bool)  # the last is that of -1
        here[known] = True
        at = np.flatnonzero(here[features].any(0))
        out[:, k] = np.bincount(np.unique(owners[at] << BITS | features[0, at]) >> BITS, minlength=rows)
    return out


def _rows(owners: np.ndarray, features: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each row, and offsets. Negative ones are none."""
    pairs = np.unique((owners << BITS | features)[features >= 0])
    return (pairs & (1 << BITS) - 1).astype(np.int32), np.searchsorted(pairs >> BITS, np.arange(rows + 1))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, part, toxic, chosen) to (part, toxic, chosen, features)."""
    for batch in batches:
        for low, high, _, owners, features in measures(batch.column(1)):
            own = _rows(np.tile(owners, len(features)), features.reshape(-1), high - low)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, high - low) for k in (2, 3, 4)), textscan.binaries(*own)], names=["part", "toxic", "chosen", "features"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, toxic, chosen, features) to the features that tell toxic documents, by part, and those that enough chosen documents have."""
    parts = len(TOXIC)
    counts, docs, df = np.zeros((parts, 2, 1 << BITS), dtype=np.uint16), np.zeros((parts, 2)), np.zeros(1 << BITS, dtype=np.uint16)  # of FIT_ROWS documents
    for batch in batches:
        for part, toxic, chosen, x in zip(*(batch.column(k) for k in range(4)), strict=True):
            own, part, toxic = np.frombuffer(x.as_buffer(), np.int32), part.as_py(), toxic.as_py()
            if toxic is not None:
                counts[part, int(toxic >= 1), own] += 1
                docs[part, int(toxic >= 1)] += 1
            if chosen.as_py():
                df[own] += 1
    lists = []
    for k in range(parts):
        enough = np.flatnonzero(counts[k, 1] >= LEARNT_DOCS)
        bad, good = ((counts[k, y, enough].astype(np.float64) + 0.5) / (docs[k, y] + 1) for y in (1, 0))
        lists.append(enough[bad >= LEARNT_LIFT * good])
    found = [*lists, np.flatnonzero(df >= LEAST_DOCS)]
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(found).astype(np.int32).tobytes()], pa.binary()), pa.array([[len(x) for x in found]])], names=["learnt", "sizes"])


def _cast(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text_hash, taught: which labeller learnt from it, if any) to (doc_id, text_hash, pattern of votes, features): the bins, and after them the places of its known features."""
    *lists, known = sent.value
    place = np.full((1 << BITS) + 1, -1, dtype=np.int32)  # the last is that of -1
    place[known] = _BASES[-1] + np.arange(len(known))
    for batch in batches:
        for low, high, shape, owners, features in measures(batch.column(1)):
            rows = high - low
            learnt = learnt_counts(owners, features, rows, lists)
            taught = batch.column(3).slice(low, rows).fill_null(-1).to_numpy()
            own_rows = np.flatnonzero(taught >= 0)
            others = np.arange(len(TOXIC)) != taught[own_rows, None]
            learnt[own_rows, taught[own_rows]] = (learnt[own_rows] * others).sum(1) / (len(TOXIC) - 1)
            says = learnt.copy()
            says[own_rows, taught[own_rows]] = np.nan
            for k, x in enumerate(lists):
                if not len(x):
                    says[:, k] = np.nan  # an empty list abstains
            bin_owners, numbers = bins(np.c_[shape, learnt, learnt.mean(1) / np.maximum(1, shape[:, 0])])
            own = _rows(np.r_[np.tile(owners, len(features)), bin_owners], np.r_[place[features].reshape(-1), numbers], rows)
            pattern = (votes(shape, says) * 3 ** np.arange(len(JUNK) + len(TOXIC))).sum(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(low, rows) for k in (0, 2)), pa.array(pattern, pa.int32()), textscan.binaries(*own)], names=["doc_id", "text_hash", "pattern", "features"])


def estimate(patterns: np.ndarray, counts: np.ndarray, gold: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over patterns [patterns, labellers]. gold: the labeller that is trusted more at the start. Gives each pattern's posterior of bad, each labeller's rates of BAD given good and bad, and the prior."""
    rates = np.tile([0.1, 0.7], (patterns.shape[1], 1))
    rates[gold] = 0.03, 0.97
    prior, posterior = 0.2, np.zeros(len(counts))
    for _ in range(rounds):
        says_bad, says_good = patterns == BAD, patterns == GOOD
        odds = np.log(prior / (1 - prior)) + (says_bad * np.log(rates[:, 1] / rates[:, 0]) + says_good * np.log((1 - rates[:, 1]) / (1 - rates[:, 0]))).sum(1)
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            break
        posterior = new
        for y, w in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            bad, good = (w[:, None] * says_bad).sum(0), (w[:, None] * says_good).sum(0)
            rates[:, y] = np.clip((bad + (0.1, 0.7)[y]) / (bad + good + 1), 1e-4, 1 - 1e-4)
        prior = np.clip((counts * posterior).sum() / max(1, counts.sum()), 1e-4, 0.9)
    return posterior, rates, float(prior)


def fit(rows: list[np.ndarray], targets: np.ndarray, size: int, epochs: int = 12, rate: float = 0.3, decay: float = 3e-5, seed: int = 5) -> np.ndarray:
    """Logistic scorers of probabilities targets [rows, questions] over `size` features, by AdaGrad: weights [size + 1, questions]; the last is the bias."""
    w, g = np.zeros((size + 1, targets.shape[1])), np.full((size + 1, targets.shape[1]), 1e-2)
    if len(rows):
        base = np.clip(targets.mean(0), 1e-3, 1 - 1e-3)
        w[-1] = np.log(base / (1 - base))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for batch in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            if not len(batch):
                continue
            flat = np.concatenate([np.r_[rows[i], size] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i]) + 1 for i in batch])
            error = score(flat, owner, w, len(batch)) - targets[batch]
            at, where = np.unique(flat, return_inverse=True)
            grad = np.stack([np.bincount(where, weights=error[owner, q], minlength=len(at)) for q in range(error.shape[1])], axis=1) / len(batch)
            grad[:-1] += decay * w[at[:-1]]
            g[at] += grad**2
            w[at] -= rate * grad / np.sqrt(g[at])
    return w


def score(flat: np.ndarray, owner: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """[rows, questions] probabilities of rows by their features."""
    odds = np.stack([np.bincount(owner, weights=w[flat, q], minlength=rows) for q in range(w.shape[1])], axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _fit(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(features, junk, toxic) to the weights."""
    rows, targets = [], []
    for batch in batches:
        rows += [np.frombuffer(x.as_buffer(), np.int32).copy() for x in batch.column(0)]
        targets.append(np.stack([batch.column(k).to_numpy() for k in (1, 2)], axis=1))
    w = fit(rows, np.concatenate(targets) if targets else np.zeros((0, 2)), size)
    yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()])], names=["weights"])


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, features) to (doc_id, junk, toxic, text_hash)."""
    w = np.frombuffer(sent.value, np.float64).reshape(-1, 2)
    for batch in batches:
        rows = [np.frombuffer(x.as_buffer(), np.int32) for x in batch.column(2)]
        owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        flat = np.concatenate([*rows, np.full(len(rows), len(w) - 1, dtype=np.int32)])
        out = score(flat, np.r_[owner, np.arange(len(rows))], w, len(rows))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[:, 0]), pa.array(out[:, 1]), batch.column(1)], names=["doc_id", "junk", "toxic", "text_hash"])


def posteriors(counted: list[tuple[int, int, int, int]]) -> list[np.ndarray]:
    """Of counts (pattern, gold_junk, gold_toxic, documents), each one's posteriors of junk and of toxic."""
    labellers = len(JUNK) + len(TOXIC)
    digits = np.array([[r[0] // 3**k % 3 for k in range(labellers)] + [r[1], r[2]] for r in counted], dtype=np.int64).reshape(-1, labellers + 2)
    count = np.array([r[3] for r in counted], dtype=np.float64)
    own = [*range(len(JUNK)), labellers], [*range(len(JUNK), labellers), labellers + 1]
    return [estimate(digits[:, k], count, len(k) - 1)[0] for k in own]


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text; further columns are ignored, whatever their names): doc_id, junk and toxic (the scorer's probabilities), kept (both below THRESHOLD), and text_hash, xxhash64 of the text, on which alone the verdict depends.

    labels: (doc_id, quality 0/1, toxic 0/1); of several rows of a document the worst counts, nulls are no vote, and so are rows without doc_id. A null or empty text has no words and is scored by its empty counts and the bias. Texts of any length are measured whole, one at a time beyond a megabyte. Repeated rows and null ids are scored like any other; null ids aren't fitted on, and of rows with one doc_id one is. Ties of hashes go by doc_id. The fit takes fit_rows documents, with or without a label, whose targets are the posteriors of their votes. Without labels the heuristics of shape alone estimate. No rows give no rows."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "classifier")
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gold = columns(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    gold = scratch.save(gold.agg((1 - F.min("quality")).cast("int").alias("gold_junk"), F.max("toxic").cast("int").alias("gold_toxic")).where("doc_id is not null"), "gold")
    least = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    labelled = least(gold.where("gold_toxic is not null").select("doc_id", F.col("gold_toxic").alias("toxic")))
    chosen = scratch.save(least(own.where("doc_id is not null").select("doc_id")).distinct(), "chosen")
    few = scratch.save(labelled.join(chosen.withColumn("chosen", F.lit(True)), "doc_id", "full"), "few")  # twice fit_rows at most
    sample = own.join(F.broadcast(few), "doc_id").dropDuplicates(["doc_id"])
    part = F.pmod(F.xxhash64("doc_id"), F.lit(len(TOXIC))).cast("int")
    sample = sample.select("doc_id", "text", part.alias("part"), "toxic", F.coalesce("chosen", F.lit(False)).alias("chosen"))
    sample = scratch.save(sample.mapInArrow(_gather, "part int, toxic int, chosen boolean, features binary"), "sample")
    learnt = sample.repartition(1).mapInArrow(_learn, "learnt binary, sizes array<long>").first() or (b"", [0] * (len(TOXIC) + 1))
    learnt = np.split(np.frombuffer(bytes(learnt[0]), np.int32), np.cumsum(learnt[1])[:-1])
    sent = spark.sparkContext.broadcast(learnt)  # features that LEAST_DOCS of the chosen or LEARNT_DOCS of the labelled documents share
    taught = few.where("toxic is not null").select("doc_id", part.alias("taught"))  # fit_rows at most
    hashed = own.join(F.broadcast(taught), "doc_id", "left").select("doc_id", "text", F.xxhash64("text").alias("text_hash"), "taught")
    cast = scratch.save(hashed.mapInArrow(lambda batches: _cast(batches, sent), "doc_id long, text_hash long, pattern int, features binary"), "cast")
    silent = lambda c: F.coalesce(c, F.lit(NONE)).alias(c)
    votes_of = lambda df: df.join(gold, "doc_id", "left").withColumns({c: silent(c) for c in ("gold_junk", "gold_toxic")})
    counted = [tuple(r) for r in votes_of(cast.select("doc_id", "pattern")).groupBy("pattern", "gold_junk", "gold_toxic").count().collect()]  # at most 3 ** 11 patterns
    table = [(*r[:3], float(a), float(b)) for r, a, b in zip(counted, *posteriors(counted), strict=True)]
    table = spark.createDataFrame(table, "pattern int, gold_junk int, gold_toxic int, junk double, toxic double")
    fitted = votes_of(with_ids(cast, chosen).dropDuplicates(["doc_id"])).join(F.broadcast(table), ["pattern", "gold_junk", "gold_toxic"])
    size = int(_BASES[-1]) + len(learnt[-1])
    model = scratch.save(fitted.select("features", "junk", "toxic", "doc_id").repartition(1).sortWithinPartitions("doc_id").mapInArrow(lambda batches: _fit(batches, size), "weights binary"), "model").first()
    weights = spark.sparkContext.broadcast(bytes(model[0]) if model else np.zeros((size + 1, 2)).tobytes())  # no rows, no weights
    scratch.retain("cast")
    scored = cast.select("doc_id", "text_hash", "features").mapInArrow(lambda batches: _score(batches, weights), "doc_id long, junk double, toxic double, text_hash long")
    return scored.withColumn("kept", (F.col("junk") < THRESHOLD) & (F.col("toxic") < THRESHOLD))
