"""Token ids of whole Arrow batches of texts by a public byte-level tokenizer.

Byte-level BPE never merges across the pieces of its splitting pattern, so a text's ids are those of its pieces, one after the other. Pieces are found with numpy by byte classes, known by 64-bit hash in a bounded table, and each new one is encoded once by the tokenizers library. A text with white space beyond ASCII, where the byte classes can't tell the pieces, is encoded by the library as a whole; so is one that holds the string of a special token, where such strings count as their tokens."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sievework.llm import textscan

_SPACE, _LETTER, _DIGIT, _OTHER, _WIDE = range(5)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[128:] = _WIDE
_BITS = 20  # of the table's slots; it grows only for one text with millions of pieces
_MOST = 1 << 19  # pieces in the table before it starts anew


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder:
    def __init__(self, path: str | None = None, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = not special  # if not special, their strings in a text are ordinary text
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.letters = _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self._table(_BITS)
        self.at, self.n = np.zeros(_MOST * 2 + 1, np.int64), 0
        self.ids = np.zeros(1 << 20, np.uint32)

    def _table(self, bits: int) -> None:
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        out, left, slot = np.full(len(h), -1, dtype=np.int32), np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            same = there == h[left]
            out[left[same]] = self.entry[slot[same]]
            on = ~same & (there != 0)
            left, slot = left[on], (slot[on] + 1) & self.last
        return out

    def _insert(self, h: np.ndarray, entries: np.ndarray) -> None:
        left, slot = np.arange(len(h)), (h >> self.shift).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            mine = free & (self.keys[slot] == h[left])
            self.entry[slot[mine]] = entries[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & self.last

    def _encode(self, piece: bytes) -> list[int]:
        if b"'" in piece or max(piece) > 127:
            return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        return [t.id for t in self.tokenizer.model.tokenize("".join([self.letters[b] for b in piece]))]

    def _learn(self, h: np.ndarray, pieces: list[bytes]) -> None:
        new = [self._encode(p) for p in pieces]
        if self.n + len(new) > len(self.at) - 1:
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(new)), np.int64)])
        flat = np.fromiter((i for x in new for i in x), dtype=np.uint32)
        end = self.at[self.n] + np.cumsum([len(x) for x in new])
        if end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.at[self.n] : end[-1]] = flat
        self.at[self.n + 1 : self.n + 1 + len(new)] = end
        if self.n + len(new) > len(self.keys) * 0.7:
            keys, entry = self.keys, self.entry
            self._table(int(np.ceil(np.log2((self.n + len(new)) * 2))))
            self._insert(keys[keys != 0], entry[keys != 0])
        self._insert(h, np.arange(self.n, self.n + len(new), dtype=np.int32))
        self.n += len(new)

    def _marked(self, data: np.ndarray) -> np.ndarray:
        """Places of the strings of added tokens."""
        text, found = data.tobytes(), []
        for mark in self.marks:
            at = text.find(mark)
            while at >= 0:
                found.append(at)
                at = text.find(mark, at + 1)
        return np.array(found, dtype=np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids and len + 1 offsets."""
        kinds = _CLASS[data]
        after = np.r_[data[1:], np.uint8(0)] if len(data) else data
        third = np.r_[data[2:], np.zeros(min(2, len(data)), np.uint8)]
        letter = (data == 0xC3) & (after != 0x97) & (after != 0xB7)  # U+00C0 to U+00FF without the two signs
        kinds[letter] = _LETTER
        kinds[np.flatnonzero(letter) + 1] = _LETTER
        odd = (data >= 0x1C) & (data <= 0x1F) | (data == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (data == 0xE1) & (after == 0x9A) & (third == 0x80) | (data == 0xE3) & (after == 0x80) & (third == 0x80)
        odd |= (data == 0xE2) & ((after == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (after == 0x81) & (third == 0x9F))
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        space = kinds == _SPACE
        start = edge[:-1].copy()
        if len(data) > 1:
            now, was, b, c = space[1:], space[:-1], kinds[:-1], kinds[1:]
            ends = np.r_[~space[2:], False] & ~edge[2:]  # a run's last character, before other text
            start[1:] |= now & (~was | ends) | ~now & was & (data[:-1] != 32)
            start[1:] |= ~now & ~was & (b != c) & (b != _WIDE) & (c != _WIDE) & (data[:-1] != 39)
        starts = np.flatnonzero(start)
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        owner = np.searchsorted(starts, offsets)
        h = textscan.hash_spans(data, starts, ends) | np.uint64(1)
        entries = self._find(h)
        if (entries < 0).any():
            if self.n > _MOST:
                self._clear()
                entries[:] = -1
            fresh, where = np.unique(h[entries < 0], return_index=True)
            where = np.flatnonzero(entries < 0)[where]
            text = data.tobytes()
            self._learn(fresh, [text[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            entries[entries < 0] = self._find(h[entries < 0])
        sizes = self.at[entries + 1] - self.at[entries]
        total = np.r_[0, np.cumsum(sizes)]
        ids = self.ids[np.repeat(self.at[entries] - total[:-1], sizes) + np.arange(total[-1])]
        out = total[owner]
        marked = self._marked(data)
        if len(marked) or odd.any():
            whole = np.unique(np.searchsorted(offsets, np.concatenate([np.flatnonzero(odd), marked]), side="right") - 1)
            parts = [ids[out[d] : out[d + 1]] for d in range(len(out) - 1)]
            for d in whole:
                parts[d] = np.array(self.tokenizer.encode(data[offsets[d] : offsets[d + 1]].tobytes().decode(), add_special_tokens=False).ids, dtype=np.uint32)
            ids, out = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, out


_encoders: dict[tuple[str | None, bool], Encoder] = {}


def encoder(path: str | None = None, special: bool = True) -> Encoder:
    """This process's encoder; its table stays from task to task."""
    if (path, special) not in _encoders:
        _encoders[path, special] = Encoder(path, special)
    return _encoders[path, special]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, dtype=ids.dtype)
    keep = np.ones(len(out), dtype=bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, offsets + np.arange(n + 1)


def encoded(column: pa.Array, end: int, path: str | None = None, special: bool = True):
    """Runs of rows: first row, row after the last, ids with the end id after each text, offsets. special: strings of special tokens in a text are those tokens, as the library has it by default; else they are ordinary text."""
    for low, high, data, offsets in textscan.slices(column):
        yield low, high, *with_end(*encoder(path, special).encode(data, offsets), end)
