"""Words, lines and hashes of whole Arrow batches of texts, with numpy and without a Python object per word.

Hashes are 64 bits: a polynomial over random byte values modulo 2^64, mixed with the length. They are the same in every process."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_STEP = 1 << 18  # bytes hashed at a time


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64's)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream64(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit integers."""
    start = np.full(n, seed * 0x9E3779B97F4A7C15 % (1 << 64), dtype=U64)
    return mix64(start + np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95))


WS_BYTES = np.zeros(256, dtype=bool)
WS_BYTES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Two independent polynomials: byte values, multiplier and its inverse.
_POLYNOMIALS = [(stream64(11, 256), r, pow(r, -1, 1 << 64)) for r in (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)]
_POLYNOMIALS[1] = (stream64(12, 256), *_POLYNOMIALS[1][1:])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, _STEP + 65536)
        p = np.full(size, base, dtype=U64)
        p[0] = 1
        have = np.multiply.accumulate(p)
        if size <= 4 * _STEP:
            _powers[base] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and len + 1 offsets. A null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` bytes (a longer text stands alone): first row, row after the last, bytes, offsets."""
    data, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = WS_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (len + 1 of them). apart: the bytes between words."""
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], which: int = 0) -> np.ndarray:
    """64-bit hashes by polynomial 0 or 1, [1 + sizes, spans]: of each span of bytes, and of its first n bytes for each n of sizes (the span itself if it is shorter). Spans are in order and don't overlap."""
    values, r, inverse = _POLYNOMIALS[which]
    out = np.empty((1 + len(sizes), len(starts)), dtype=U64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, low + _STEP, side="right")))
        high = int(ends[end - 1])
        p = np.zeros(high - low + 1, dtype=U64)
        np.cumsum(values[data[low:high]] * _power(r, high - low)[: high - low], out=p[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        base, scale = p[s], _power(inverse, high - low)[s]
        for k, stop in enumerate((e, *(np.minimum(e, s + n) for n in sizes))):
            out[k, at:end] = (p[stop] - base) * scale + (stop - s).astype(U64) * U64(0x9E3779B97F4A7C15)
        at = end
    return mix64(out)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    return hash_heads(data, starts, ends, (), which)[0]


def distinct(owner: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """How many different hashes each of fewer than 2^20 rows has, by their upper 44 bits."""
    key = np.sort(owner.astype(U64) << U64(44) | hashes >> U64(20))
    fresh = np.ones(len(key), dtype=bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    return np.bincount((key[fresh] >> U64(44)).astype(np.int64), minlength=rows)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of all lines; a text without a break is one line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    # a text that ends with a break has an empty last line, whose start is the next text's start too; both sorts keep pairs in order
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.repeat(np.arange(len(per)), per)


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of `width` words, sorted, and offsets. A text with fewer words has them all as its one shingle; one without words has none."""
    n = len(first) - 1
    factors = stream64(23, width)
    per = np.diff(first)
    count = np.where(per >= width, per - width + 1, (per > 0).astype(np.int64))
    windows = np.zeros(max(0, len(word_hash) - width + 1), dtype=U64)
    for j in range(width):
        windows += word_hash[j : j + len(windows)] * factors[j]
    windows = mix64(windows)
    kept, at = np.zeros(n + 1, np.int64), []
    for d in range(n):
        if per[d] >= width:
            s = np.sort(windows[first[d] : first[d] + count[d]])
            fresh = np.ones(len(s), dtype=bool)
            np.not_equal(s[1:], s[:-1], out=fresh[1:])
            s = s[fresh]
        elif per[d]:
            s = mix64((word_hash[first[d] : first[d + 1]] * factors[: per[d]]).sum(dtype=U64, keepdims=True) + U64(int(per[d])))
        else:
            continue
        at.append(s)
        kept[d + 1] = len(s)
    return (np.concatenate(at) if at else np.zeros(0, U64)), np.cumsum(kept)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binaries(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of the slices of a flat array at the given offsets (in items)."""
    data = np.ascontiguousarray(flat)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64) * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())
