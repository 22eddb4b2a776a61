"""Vectorised text kernels on the UTF-8 bytes of an Arrow column.

Every function works on one ``Texts`` block: the concatenated bytes of some documents and their
offsets. Spark hands over record batches; ``blocks`` cuts them so that the working arrays stay
near ``limit`` bytes of text (a single longer document is a block of its own).

Hashes are 64 bits: a polynomial over the bytes, read off one prefix sum in wrap-around
arithmetic, then mixed. Equal byte strings have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 18
#: Rows of a record batch whose texts are laid out at a time.
SLICE = 256
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, U)
_inverse = np.ones(1, U)

#: The six white-space bytes of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True
#: ASCII upper case to lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Whatever isn't an ASCII letter or digit or part of a multi-byte character.
NOT_WORD = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if n > len(_powers):
        m = max(n, BLOCK + 1)
        inv = pow(int(_BASE), -1, 1 << 64)
        up, down = np.full(m, _BASE), np.full(m, U(inv))
        up[0] = down[0] = U(1)
        _powers, _inverse = np.cumprod(up), np.cumprod(down)
    return _powers[:n], _inverse[:n]


class Texts:
    """Concatenated UTF-8 of n documents; document i is data[offsets[i]:offsets[i + 1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self._sums: dict[bool, np.ndarray] = {}

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self, counts: np.ndarray) -> np.ndarray:
        return np.repeat(np.arange(self.n), counts)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """Flagged bytes of each document."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def chars(self) -> np.ndarray:
        """Code points of each document."""
        return self.count((self.data & 0xC0) != 0x80)

    def runs(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each maximal run of bytes that aren't separators, and runs of each document."""
        inside = ~separators[self.data]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n, np.int64)
        first, last = np.empty_like(inside), np.empty_like(inside)
        first[0], last[-1] = True, True
        np.logical_not(inside[:-1], out=first[1:])
        np.logical_not(inside[1:], out=last[:-1])
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(inside))]
        first[cuts], last[cuts - 1] = True, True
        first &= inside
        last &= inside
        return np.flatnonzero(first), np.flatnonzero(last) + 1, self.count(first)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        if lower not in self._sums:
            up, _ = powers(len(self.data))
            value = LOWER[self.data] if lower else self.data
            sums = np.zeros(len(self.data) + 1, U)
            np.cumsum((value.astype(U) + U(1)) * up, out=sums[1:])
            self._sums[lower] = sums
        sums = self._sums[lower]
        _, down = powers(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts])

    def lower(self) -> Texts:
        return Texts(LOWER[self.data], self.offsets)


def texts(column: pa.Array) -> Texts:
    """A string column as Texts; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0])


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of a record batch with about ``limit`` bytes of text each, a document at least."""
    number = batch.schema.get_field_index(column)
    for begin in range(0, batch.num_rows, SLICE):
        some = batch.slice(begin, SLICE)
        whole = texts(some.column(number))
        at = 0
        while at < whole.n:
            to = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1)
            offsets = whole.offsets[at : to + 1]
            yield some.slice(at, to - at), Texts(whole.data[offsets[0] : offsets[-1]], offsets - offsets[0])
            at = to


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs (a[i], b[i])."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def window_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside a document, each window's first word, windows of each document."""
    many = np.maximum(counts - width + 1, 0)
    if not many.sum():
        return np.zeros(0, U), np.zeros(0, np.int64), many
    begin = np.cumsum(counts) - counts
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    found = words[at]
    for k in range(1, width):
        found = found * U(0xD6E8FEB86659FD93) + words[at + k]
    return mix(found), at, many


def shingles(t: Texts, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``width`` words and how many each document has.

    A document of 1 to width - 1 words has one shingle, of all its words; one without words has none.
    """
    starts, ends, counts = t.runs(SPACE)
    words = t.hashes(starts, ends)
    found, _, many = window_hashes(words, counts, width)
    short = (counts > 0) & (counts < width)
    if short.any():
        begin = np.cumsum(counts) - counts
        extra = []
        for n in range(1, width):
            which = np.flatnonzero(counts == n)
            own = words[begin[which]]
            for k in range(1, n):
                own = own * U(0xD6E8FEB86659FD93) + words[begin[which] + k]
            extra.append((which, mix(own + U(n))))
        which = np.concatenate([x[0] for x in extra])
        doc = np.concatenate([np.repeat(np.arange(t.n), many), which])
        found = np.concatenate([found, *(x[1] for x in extra)])
        found = found[np.argsort(doc, kind="stable")]
        many = many + short
    return found, many
