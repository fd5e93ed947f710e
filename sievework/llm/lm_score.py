"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Documents become blocks: their tokens as codes into the block's distinct words. Each block sends its distinct words with their training counts to shards by hash, once each however often they occur; a shard adds up and answers every block. That gives exact counts of all words without joining tokens.

The model predicts classes: the VOCABULARY most frequent words are classes of their own, all others fall into SUFFIXES classes by their last bytes, with add-one shares of the class within it. A class's score is the product of its vector with the sum of the CONTEXT previous classes' vectors, each weighted by position, plus a bias. Every partition trains a copy on its training tokens by noise-contrastive estimation, in minibatches of matrix products; copies are averaged by Spark, ROUNDS times, each round taking its share of the minibatches, so that all training tokens are used. A minibatch's gradients are summed by class over one sort. Scoring normalises over all classes: the exponential of a score is a product with one factor for each position's class, so the factors are tabled once for a block and a token costs CONTEXT products a class, with no exponential and no matrix product."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import textscan, tokens
from sievework.llm.common import Scratch, columns

VOCABULARY, SUFFIXES = 192, 64
CLASSES = VOCABULARY + SUFFIXES
START = CLASSES  # the class before a document's first token, in contexts only
CONTEXT, WIDTH, NOISE = 4, 32, 64
ROUNDS, BATCH, RATE = 3, 512, 0.2
LEAST = 1e-25  # sums of products below that are taken again by logarithms
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1_000_000  # words of all blocks that a shard holds, about
HELD_MODULUS, HELD = 7, 2
END_HASH = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "block long, doc_ids array<long>, held binary, lengths binary, n_distinct long, hashes binary, suffix binary, counts binary, codes binary"


def held_out(doc_id: int | None) -> bool:
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % HELD_MODULUS == HELD


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_BYTES, so that a word is counted once in many texts."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(level=1)
    for batch in _gathered(batches):
        for low, high, data, offsets in textscan.slices(batch.column(1), 2 * BLOCK_BYTES):
            lower = textscan.LOWER[data]
            starts, ends, first = textscan.words(lower, offsets)
            every, firsts = tokens.with_end(textscan.hash_spans(lower, starts, ends), first, END_HASH)
            tails, _ = tokens.with_end(textscan.hash_spans(lower, np.maximum(starts, ends - 3), ends) % np.uint64(SUFFIXES), first, 0)
            ids = batch.column(0).slice(low, high - low).to_pylist()
            held = np.array([held_out(i) for i in ids])
            words, where, codes = np.unique(every, return_index=True, return_inverse=True)
            lengths = np.diff(firsts)
            counts = np.bincount(codes[~np.repeat(held, lengths)], minlength=len(words))
            one = lambda x: pa.array([x.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | at], pa.int64()), pa.array([ids], pa.list_(pa.int64())), one(held), one(lengths.astype(np.int32)), pa.array([len(words)], pa.int64()), one(words), one(tails[where].astype(np.uint8)), one(counts.astype(np.int32)), pa.array([press.compress(codes.astype(np.int32).tobytes())], pa.binary())], names=[x.split()[0] for x in _BLOCK.split(", ")])
            at += 1


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def _deal(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(block, hashes, suffix, counts) to a row for each shard."""
    for batch in batches:
        for row in range(batch.num_rows):
            block = batch.column(0)[row].as_py()
            hashes, suffix, counts = (np.frombuffer(batch.column(k)[row].as_py(), t) for k, t in ((1, np.uint64), (2, np.uint8), (3, np.int32)))
            to = _shard_of(hashes, shards)
            own = [np.flatnonzero(to == s) for s in np.unique(to)]
            cols = [[x[i].tobytes() for i in own] for x in (hashes, suffix, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(to)), pa.array([block] * len(own), pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["shard", "block", "hashes", "suffix", "counts"])


_ANSWER = "block long, shard int, found binary, n array<long>, v array<long>, top_hash array<long>, top_count array<long>, top_suffix array<long>"


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    """All blocks' words of a shard to each block's counts, and a row with block null that sums the shard up."""
    parts = [np.frombuffer(x, np.uint64) for x in group["hashes"]]
    words, where, code = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    total = np.bincount(code, weights=np.concatenate([np.frombuffer(x, np.int32) for x in group["counts"]]), minlength=len(words)).astype(np.int64)
    suffix = np.concatenate([np.frombuffer(x, np.uint8) for x in group["suffix"]])[where]
    edges = np.cumsum([0, *map(len, parts)])
    answers = [total[code[a:b]].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
    n = np.bincount(suffix, weights=total, minlength=SUFFIXES).astype(np.int64)
    v = np.bincount(suffix[total > 0], minlength=SUFFIXES)
    top = np.lexsort((words, -total))[:VOCABULARY]
    top = top[total[top] > 0]
    m = len(parts)
    return pd.DataFrame({"block": pd.array([*group["block"], None], dtype="Int64"), "shard": int(group["shard"].iloc[0]), "found": [*answers, None], "n": [None] * m + [n.tolist()], "v": [None] * m + [v.tolist()], "top_hash": [None] * m + [textscan.signed(words[top]).tolist()], "top_count": [None] * m + [total[top].tolist()], "top_suffix": [None] * m + [suffix[top].astype(np.int64).tolist()]})


class Model:
    """Vectors of contexts and classes, position weights and biases."""

    def __init__(self, prior: np.ndarray, seed: int = 3):
        r = np.random.default_rng(seed)
        self.prior = prior
        self.p = {"r": r.normal(0, 0.1, (CLASSES + 1, WIDTH)), "q": r.normal(0, 0.1, (CLASSES, WIDTH)), "c": np.ones((CONTEXT, WIDTH)), "b": np.log(prior)}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].reshape(-1) for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).copy()
            at += n

    def log10(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of the targets."""
        part = np.stack([(self.p["r"] * c) @ self.p["q"].T for c in self.p["c"]])  # [CONTEXT, CLASSES + 1, CLASSES]
        part[0] += self.p["b"]
        part -= part.max(2, keepdims=True)  # factors of 1 at most, so no product overflows
        part, factor = part.reshape(-1, CLASSES), np.exp(part).astype(np.float32).reshape(-1, CLASSES)
        out = np.empty(len(target))
        for low in range(0, len(target), BATCH):
            at = context[low : low + BATCH].T + np.arange(0, len(part), CLASSES + 1)[:, None]
            product = factor.take(at[0], 0)
            for j in range(1, CONTEXT - 1):
                product *= factor.take(at[j], 0)
            total = np.einsum("nk,nk->n", product, factor.take(at[-1], 0)).astype(np.float64)
            log = np.log(np.maximum(total, LEAST))
            few = np.flatnonzero(total < LEAST)  # their positions agree on no class, and products are too small for float32
            if len(few):
                score = part[at[:, few]].sum(0)
                most = score.max(1)
                log[few] = most + np.log(np.exp(score - most[:, None]).sum(1))
            out[low : low + BATCH] = part.take(at * CLASSES + target[low : low + BATCH]).sum(0) - log
        return out / np.log(10)

    def step(self, context: np.ndarray, target: np.ndarray, noise: np.ndarray, square: dict[str, np.ndarray]) -> None:
        """One AdaGrad step of noise-contrastive estimation; the noise is shared by the minibatch."""
        p, n = self.p, len(target)
        r, q, c = (p[k].astype(np.float32) for k in "rqc")
        before, own = r.take(context, 0), q.take(target, 0)
        h = np.einsum("njw,jw->nw", before, c)
        bias = (p["b"] - np.log(NOISE * self.prior)).astype(np.float32)
        real = 1 / (1 + np.exp(np.clip(np.einsum("nw,nw->n", h, own) + bias[target], -30, 30)))  # how much too low
        times = np.bincount(noise, minlength=CLASSES)
        drawn = np.flatnonzero(times)  # a class drawn again counts again
        other = q[drawn]
        false = h @ -other.T - bias[drawn]
        np.exp(np.clip(false, -30, 30, out=false), out=false)
        false += 1
        np.divide(-times[drawn].astype(np.float32), false, out=false)  # how much too high
        dh = real[:, None] * own + false @ other
        grad = {"b": np.bincount(target, weights=real, minlength=CLASSES), "c": np.einsum("njw,nw->jw", before, dh)}
        grad["b"][drawn] += false.sum(0)
        grad["q"] = self._sum(target, lambda at: real[at, None] * h.take(at, 0), CLASSES)
        grad["q"][drawn] += false.T @ h
        grad["r"] = self._sum(context.reshape(-1), lambda at: dh.take(at // CONTEXT, 0) * c.take(at % CONTEXT, 0), CLASSES + 1)
        for k in p:
            g = grad[k] / n
            square[k] += g * g
            p[k] += RATE * g / np.sqrt(square[k])

    @staticmethod
    def _sum(keys: np.ndarray, rows: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sums of rows by key, a class; rows gives those of an order."""
        keys = keys.astype(np.uint16)  # sorted by digits
        order = keys.argsort(kind="stable")
        there = keys[order]
        first = np.append(0, np.flatnonzero(there[1:] != there[:-1]) + 1)
        out = np.zeros((size, WIDTH), np.float32)
        out[there[first]] = np.add.reduceat(rows(order).view(np.complex64), first).view(np.float32)  # columns in pairs, which halves the calls
        return out


class Lexicon:
    """Classes of words, and the model's start."""

    def __init__(self, top: list[tuple[int, int, int]], n: np.ndarray, v: np.ndarray):
        words = np.array([h for h, _, _ in top], dtype=np.int64).view(np.uint64)
        order = np.argsort(words)
        self.words, self.classes = words[order], order
        self.N, self.V = int(n.sum()), int(v.sum())
        self.rest_n, self.rest_v = n.copy(), v.copy()
        for _, count, suffix in top:
            self.rest_n[suffix] -= count
            self.rest_v[suffix] -= 1
        counts = np.concatenate([np.array([c for _, c, _ in top] + [0] * (VOCABULARY - len(top)), dtype=np.float64), self.rest_n])
        self.prior = (counts + 1) / (counts.sum() + CLASSES)

    def of(self, hashes: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        out = VOCABULARY + suffix.astype(np.int64)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            here = self.words[at] == hashes
            out[here] = self.classes[at[here]]
        return out


def _contexts(classes: np.ndarray, lengths: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """[tokens, CONTEXT] of the classes before each token of its document, or before the tokens at `at`."""
    place = np.arange(len(classes)) + np.repeat(CONTEXT * np.arange(1, len(lengths) + 1), lengths)
    apart = np.full(len(classes) + CONTEXT * len(lengths), START, dtype=np.uint16)  # with a start's classes before each document
    apart[place] = classes
    place = place if at is None else place[at]
    out = np.empty((len(place), CONTEXT), dtype=np.uint16)
    for j in range(CONTEXT):
        out[:, j] = apart[place - j - 1]
    return out


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["held"], bool), np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(row["codes"]), np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {k: batch.column(i)[row].as_py() for i, k in enumerate(batch.schema.names)}


def _train(batches: Iterator[pa.RecordBatch], sent, turn: int) -> Iterator[pa.RecordBatch]:
    """A partition's blocks to its copy of the parameters, times its training tokens of this round."""
    lexicon, flat = sent.value
    model, used = Model(lexicon.prior), 0
    model.load(flat)
    square = {k: np.full_like(x, 1e-6) for k, x in model.p.items()}
    draw = np.random.default_rng([turn, TaskContext.get().partitionId()])
    for row in _rows(batches):
        held, lengths, codes = _open(row)
        classes = lexicon.of(np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["suffix"], np.uint8))[codes]
        own = np.flatnonzero(~np.repeat(held, lengths))
        own = own[np.arange(len(own)) // BATCH % ROUNDS == turn]
        context, target = _contexts(classes, lengths, own), classes[own]
        noise = draw.choice(CLASSES, (-(-len(own) // BATCH), NOISE), p=lexicon.prior)
        for k, low in enumerate(range(0, len(own), BATCH)):
            model.step(context[low : low + BATCH], target[low : low + BATCH], noise[k], square)
        used += len(own)
    if used:
        yield pa.RecordBatch.from_arrays([pa.array([used], pa.int64()), pa.array([(model.flat() * used).tolist()], pa.list_(pa.float64()))], names=["used", "parameters"])


def _score(batches: Iterator[pa.RecordBatch], sent, shards: int) -> Iterator[pa.RecordBatch]:
    lexicon, flat = sent.value
    model = Model(lexicon.prior)
    model.load(flat)
    for row in _rows(batches):
        held, lengths, codes = _open(row)
        hashes, suffix = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["suffix"], np.uint8)
        count, to = np.zeros(len(hashes), np.int64), _shard_of(hashes, shards)
        for answer in row["answers"]:
            count[to == answer["shard"]] = np.frombuffer(answer["found"], np.int64)
        kind = lexicon.of(hashes, suffix)
        inside = np.where(kind < VOCABULARY, 0.0, np.log10((count + 1) / (lexicon.rest_n[suffix] + lexicon.rest_v[suffix] + 1)))
        base = np.log10((count + 1) / (lexicon.N + lexicon.V + 1))[codes]
        classes = kind[codes]
        score = inside[codes] + model.log10(_contexts(classes, lengths), classes)
        first = np.cumsum(lengths) - lengths
        add = lambda x: pa.array(np.add.reduceat(x, first))
        n = len(lengths)
        yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(held), pa.array(lengths), add((count > 0)[codes].astype(np.int64)), pa.array([lexicon.N] * n, pa.int64()), add(base), add(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words without ASCII white space, A-Z lower-cased, and one end; a null or empty text is its end alone. Training takes the rows whose crc32(doc_id as text) mod 7 isn't 2; a null doc_id counts as the empty text. Repeated rows count and are scored each. Texts of any length are scored whole; further columns are ignored, whatever their names; of equally frequent words those with the smaller hash are in the vocabulary. No rows give no rows; without training rows the model is its start, with equal classes."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = scratch.save(own.mapInArrow(_blocks, _BLOCK), "blocks")
    shards = max(1, -(-(blocks.agg(F.sum("n_distinct")).first()[0] or 0) // SHARD_WORDS))
    dealt = blocks.select("block", "hashes", "suffix", "counts").mapInArrow(lambda batches: _deal(batches, shards), "shard int, block long, hashes binary, suffix binary, counts binary")
    answers = scratch.save(dealt.groupBy("shard").applyInPandas(_add_up, _ANSWER), "answers")

    sums = answers.where("block is null")
    by_suffix = {r[0]: (r[1], r[2]) for r in sums.select(F.posexplode(F.arrays_zip("n", "v")).alias("k", "x")).groupBy("k").agg(F.sum("x.n"), F.sum("x.v")).collect()}  # SUFFIXES rows
    n, v = (np.array([by_suffix.get(k, (0, 0))[i] for k in range(SUFFIXES)], dtype=np.int64) for i in (0, 1))
    top = sums.select(F.explode(F.arrays_zip("top_hash", "top_count", "top_suffix")).alias("x")).select("x.*").orderBy(F.desc("top_count"), "top_hash").limit(VOCABULARY).collect()
    lexicon = Lexicon([tuple(r) for r in top], n, v)
    flat = Model(lexicon.prior).flat()
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((lexicon, flat))  # CLASSES * WIDTH numbers or so
        copies = blocks.select("held", "lengths", "codes", "hashes", "suffix").mapInArrow(lambda batches, sent=sent, turn=turn: _train(batches, sent, turn), "used long, parameters array<double>")
        copies = scratch.save(copies, f"copies-{turn}")
        used = copies.agg(F.sum("used")).first()[0]
        if used:
            rows = copies.select(F.posexplode("parameters").alias("k", "x")).groupBy("k").agg((F.sum("x") / used).alias("x")).orderBy("k").collect()
            flat = np.array([r[1] for r in rows])
        scratch.drop(f"copies-{turn}")
    sent = spark.sparkContext.broadcast((lexicon, flat))
    found = answers.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "found")).alias("answers"))  # a block's own words
    both = blocks.select("block", "doc_ids", "held", "lengths", "codes", "hashes", "suffix").join(found, "block").drop("block")
    return both.mapInArrow(lambda batches: _score(batches, sent, shards), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
