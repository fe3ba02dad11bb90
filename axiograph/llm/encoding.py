"""Byte-level BPE ids for whole Arrow batches, through the tokenizers library.

A text is cut only where the pre-tokenizer's pattern always begins a new pre-token, so the pieces' ids in a row are the
text's ids. Each distinct short piece of a batch goes to the library once and is kept in a bounded table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from axiograph.llm.common import chunks, span_hashes

#: Pieces a Python worker keeps, and the longest that it keeps; longer ones go to the library each time.
KEPT_PIECES = 500_000
KEPT_BYTES = 64

_SPACE, _BREAK, _LETTER, _PUNCT, _DIGIT, _HIGH, _UNSURE = 1, 2, 3, 4, 5, 6, 7


def _classes() -> np.ndarray:
    c = np.full(256, _UNSURE, np.uint8)  # control bytes, and 0x80 up that may begin a Unicode space
    c[0x20] = _SPACE
    c[0x0A] = _BREAK
    for lo, hi in ((65, 91), (97, 123)):
        c[lo:hi] = _LETTER
    c[48:58] = _DIGIT
    for lo, hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
        c[lo:hi] = _PUNCT
    c[0xC3:0xE0] = _HIGH  # two-byte leads above U+00BF: no space begins so
    return c


_CLASS = _classes()


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start: every row's start, before a space that a non-space follows, between a letter and what is
    no letter, and after a lone line feed."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    c = _CLASS[data]
    cut = np.zeros(n, bool)
    solid = (c >= _LETTER) & (c <= _HIGH)
    cut[:-1] |= (c[:-1] == _SPACE) & solid[1:]
    cut[1:] |= (c[:-1] == _LETTER) & (c[1:] != _LETTER) & (c[1:] <= _PUNCT)
    lone = np.zeros(n, bool)
    lone[1:-1] = (c[1:-1] == _BREAK) & (c[:-2] >= _LETTER) & (c[:-2] <= _DIGIT) & (c[2:] >= _LETTER) & (c[2:] <= _DIGIT)
    cut |= lone & np.concatenate([[False], (c[:-1] == _LETTER) | (c[:-1] == _PUNCT) | (c[:-1] == _DIGIT)])
    cut[1:] |= lone[:-1]
    cut[at[:-1][at[:-1] < n]] = True
    return np.flatnonzero(cut)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))]


def _equal(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether each span of data is byte for byte the span of other beside it. Spans are not empty."""
    same = sizes == other_sizes
    at = np.flatnonzero(same)
    if len(at):
        n = sizes[at]
        differs = _gather(data, starts[at], n) != _gather(other, others[at], n)
        same[at] = ~np.logical_or.reduceat(differs, np.cumsum(n) - n)
    return same


class PieceEncoder:
    """encode(column) -> ids of all rows laid end to end, ids before each row. Keeps the ids of short pieces.

    Pieces are looked up by a hash, and their bytes are compared at every hit. A row with the string of an added token
    is one piece, as the library takes such strings out of the whole text first.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.widths = None
        self._forget()

    def _forget(self) -> None:
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        self.pool, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _library(self, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans laid end to end, and how many each has."""
        texts = [raw[a : a + n].decode() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _learn(self, keys: np.ndarray, data: np.ndarray, raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> None:
        """keys are in order; where: first id and number of ids in the pool, first byte and number of bytes."""
        ids, n = self._library(raw, starts, sizes)
        where = np.stack([len(self.pool) + np.cumsum(n) - n, n, len(self.bytes) + np.cumsum(sizes) - sizes, sizes], 1)
        self.pool, self.bytes = np.concatenate([self.pool, ids]), np.concatenate([self.bytes, _gather(data, starts, sizes)])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.where = np.insert(self.keys, place, keys), np.insert(self.where, place, where, axis=0)

    def _with_added(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        """Rows that hold the string of an added token."""
        rows: set[int] = set()
        for string in self.added:
            place = raw.find(string)
            while place >= 0:
                row = int(np.searchsorted(at, place, "right")) - 1
                if place + len(string) <= at[row + 1]:
                    rows.add(row)
                    place = raw.find(string, int(at[row + 1]))
                else:
                    place = raw.find(string, place + 1)
        return np.array(sorted(rows), np.int64)

    def _chunk(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, raw = cuts(data, at), data.tobytes()
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        whole = self._with_added(raw, at)
        if len(whole):
            inside = np.zeros(len(starts), bool)
            for lo, hi in zip(at[whole], at[whole + 1], strict=True):
                inside |= (starts > lo) & (starts < hi)
            starts = starts[~inside]
        sizes = np.append(starts[1:], len(data)) - starts
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        short = np.flatnonzero(sizes <= KEPT_BYTES)
        keys = span_hashes(data, starts[short], starts[short] + sizes[short])
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        of_key = short[first]  # the piece that stands for each key
        same = _equal(data, starts[short], sizes[short], data, starts[of_key][back], sizes[of_key][back])
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inner = np.flatnonzero(place < len(self.keys))
        known[inner] = self.keys[place[inner]] == distinct[inner]
        if (new := np.flatnonzero(~known)).size:
            self._learn(distinct[new], data, raw, starts[of_key[new]], sizes[of_key[new]])
            place = np.searchsorted(self.keys, distinct)
        where = self.where[place]
        right = _equal(data, starts[of_key], sizes[of_key], self.bytes, where[:, 2], where[:, 3])
        good = same & right[back]
        spans = np.zeros((len(starts), 2), np.int64)
        spans[short[good]] = where[back[good], :2]
        passing = np.ones(len(starts), bool)
        passing[short[good]] = False
        passing = np.flatnonzero(passing)  # long ones, and those whose hash another piece has
        pool = self.pool
        if len(passing):
            ids, n = self._library(raw, starts[passing], sizes[passing])
            spans[passing] = np.stack([len(pool) + np.cumsum(n) - n, n], 1)
            pool = np.concatenate([pool, ids])
        base, size = spans.T
        before = np.cumsum(size) - size
        total = int(size.sum())
        ids = pool[np.repeat(base - before, size) + np.arange(total)]
        row_first = np.searchsorted(starts, at)  # the first piece at or after each row's start
        return ids, np.append(before, total)[row_first]

    def steps(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """first row, row after the last, bytes, row starts in them, ids, row starts in those; some rows at a time."""
        for lo, hi, data, at in chunks(column):
            yield lo, hi, data, at, *self._chunk(data, at)

    def byte_widths(self) -> np.ndarray:
        """The number of bytes that each id stands for: a byte-level vocabulary writes each byte as one character, and
        an added token stands for its string."""
        if self.widths is None:
            vocab = self.library.get_vocab(with_added_tokens=False)
            added = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
            self.widths = np.zeros(max([*vocab.values(), *added.values()]) + 1, np.int64)
            for token, i in vocab.items():
                self.widths[i] = len(token)
            for token, i in added.items():
                self.widths[i] = len(token.encode())
        return self.widths


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
