"""Vectorised views of text columns inside Arrow functions: words, hashes and windows of a whole slice of rows at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds at most, unless a single text is longer; bounds the arrays below to some 50 MB.
SLICE_BYTES = 1 << 20
#: Bytes of a range up to which `word_hashes` reads it piece by piece.
WORD_BYTES = 64

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


@dataclass
class Texts:
    """Some rows of a text column. `data` holds the UTF-8 bytes of all rows; row i is data[cuts[i]:cuts[i + 1]]."""

    rows: slice
    data: np.ndarray
    cuts: np.ndarray

    def __len__(self) -> int:
        return len(self.cuts) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Cut a string column into pieces of at most `limit` bytes, or of one row. Nulls count as empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, dtype=np.int64, count=column.offset + n + 1)[column.offset:] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + limit, side="right")) - 1)
        yield Texts(slice(at, to), data[cuts[at]:cuts[to]], cuts[at:to + 1] - cuts[at])
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    upper = data - np.uint8(ord("A")) < np.uint8(26)
    return data | (upper.view(np.uint8) << np.uint8(5))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of any byte ranges of one array: differences of a running sum of coded bytes times powers of a base."""

    _powers: np.ndarray = np.ones(1, np.uint64)
    _inverse: np.ndarray = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Hasher._powers) < n + 1:
            full = np.full(n + 1, _BASE, np.uint64)
            full[0] = 1
            Hasher._powers = np.cumprod(full)
            full[1:] = np.uint64(pow(int(_BASE), -1, 1 << 64))
            Hasher._inverse = np.cumprod(full)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data] * Hasher._powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hasher._inverse[start] + (end - start).astype(np.uint64))


def words(texts: Texts, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that are no white space), and `first`: word numbers at which rows begin."""
    n = len(texts.data)
    solid = np.zeros(n + 2, dtype=bool)
    if space is _SPACE:  # comparisons are faster than looking bytes up
        solid[1:-1] = (texts.data != 0x20) & (texts.data - np.uint8(0x09) > np.uint8(4))
    else:
        solid[1:-1] = ~space[texts.data]
    edge = solid[1:] != solid[:-1]
    start, end = edge[:-1] & solid[1:-1], edge[1:] & solid[1:-1]
    inner = texts.cuts[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start[inner] = solid[inner + 1]
    end[inner - 1] = solid[inner]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, texts.cuts)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that are short as a rule: eight bytes at a time up to `WORD_BYTES`, longer ones by `Hasher`. Not equal to those of `Hasher`."""
    size = end - start
    out = size.astype(np.uint64)
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # from any byte on
    left = np.flatnonzero((size > 0) & (size <= WORD_BYTES))
    for at in range(0, WORD_BYTES, 8):
        left = left[size[left] > at]
        if not len(left):
            break
        beyond = np.maximum(0, at + 8 - size[left]).astype(np.uint64) * np.uint64(8)  # bits that aren't the word's
        part = eight[start[left] + at] << beyond
        out[left] = mixed(out[left] * np.uint64(0xD1342543DE82EF95) + part)
    long = np.flatnonzero(size > WORD_BYTES)
    if len(long):
        out[long] = Hasher(data)(start[long], end[long])
    return out


def gram_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of the words i .. i + size - 1 for every i; the caller leaves out those that cross rows."""
    n = max(0, len(word) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = mixed(total * np.uint64(0xD1342543DE82EF95) + word[k:k + n])
    return total


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, then those of start[1], and so on."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return np.arange(total, dtype=np.int64) + shift


class Grown:
    """An array that is appended to; its room doubles."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, key):
        return self.room[:self.n][key]

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[:self.n], np.zeros(max(len(more), self.n), self.room.dtype)])
        self.room[self.n:self.n + len(more)] = more
        self.n += len(more)


class Dictionary:
    """Codes 0, 1, ... of byte strings, found for a whole slice at once: open addressing by hash, then the bytes are compared."""

    def __init__(self):
        self.table = np.full(1 << 12, -1, np.int32)
        self.hashes, self.starts, self.sizes, self.data = Grown(np.uint64), Grown(np.int64), Grown(np.int64), Grown(np.uint8)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Code of each range of `data`, -1 where it is unknown. Strings that share the hash of a known one are unknown too."""
        code = self.of_hash(hashes)
        hit = np.flatnonzero(code >= 0)
        size, held = (end - start)[hit], code[hit]
        same = self.sizes[held] == size
        if not same.all():
            code[hit[~same]] = -1
            hit, size, held = hit[same], size[same], held[same]
        differs = data[ranges(start[hit], size)] != self.data[ranges(self.starts[held], size)]
        if differs.any():
            code[hit[np.searchsorted(np.cumsum(size), np.flatnonzero(differs), side="right")]] = -1
        return code

    def of_hash(self, hashes: np.ndarray) -> np.ndarray:
        """Code of the string with each hash, -1 where there is none."""
        slot = hashes & np.uint64(len(self.table) - 1)
        code = self.table[slot].astype(np.int64)
        if not len(self):
            return code
        other = np.flatnonzero((code >= 0) & (self.hashes[code] != hashes))
        while len(other):
            slot[other] = (slot[other] + np.uint64(1)) & np.uint64(len(self.table) - 1)
            code[other] = self.table[slot[other]]
            other = other[(code[other] >= 0) & (self.hashes[code[other]] != hashes[other])]
        return code

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Give the next codes, in order, to ranges with hashes that differ from one another and from all known ones."""
        first, size = len(self), end - start
        self.hashes.append(hashes)
        self.starts.append(len(self.data) + np.cumsum(size) - size)
        self.sizes.append(size)
        self.data.append(data[ranges(start, size)])
        if 2 * len(self) > len(self.table):
            self.table = np.full(1 << (4 * len(self)).bit_length(), -1, np.int32)
            first = 0
        code = np.arange(first, len(self), dtype=np.int32)
        slot = self.hashes[first:] & np.uint64(len(self.table) - 1)
        while len(code):
            free = self.table[slot] < 0
            self.table[slot[free]] = code[free]
            left = self.table[slot] != code
            code, slot = code[left], (slot[left] + np.uint64(1)) & np.uint64(len(self.table) - 1)
