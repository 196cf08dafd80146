"""Vectorised text primitives for Arrow batches.

A word is a maximal run of bytes other than space, \\t, \\n, \\v, \\f and \\r, so that
words of a UTF-8 text are those of the pattern ``[^\\x20\\x09-\\x0D]+``. All work is done
on the UTF-8 bytes of many rows at once, in chunks of a few megabytes, so a task's
memory does not depend on the number of rows. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separates runs of ASCII letters, digits and non-ASCII bytes.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) for each element."""
    h = h + _U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, from 0 to n - 1."""
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _tables[i] = np.multiply.accumulate(step)
    return _tables[0], _tables[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + 2 * CHUNK_BYTES, "right")))
        part = data[at : ends[j - 1]]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling (Rabin-Karp) hashes of every n consecutive words."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = []
    step = 1 << 20
    for at in range(0, len(words) - n + 1, step):
        part = words[at : at + step + n - 1]
        power, inverse = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out.append((sums[n:] - sums[:-n]) * inverse[: len(part) - n + 1])
    return mix(np.concatenate(out), 1)


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    #: The first word of each row, and the number of words.
    first: np.ndarray

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, n: int) -> np.ndarray:
        """Indices of the words at which a window of n words within one row starts."""
        at = np.arange(len(self.starts))
        return at[at + n <= self.first[1:][self.row]]


@dataclass
class Chunk:
    """Some rows of a batch: bytes, and where each row starts in them."""

    first_row: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def words(self, separators: np.ndarray = SPACES) -> Words:
        return self.spans(~separators[self.data])

    def spans(self, inside: np.ndarray) -> Words:
        """Maximal runs of marked bytes within rows."""
        n = len(self.data)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = self.offsets[:-1]
        before[edges[edges < n]] = False
        after[edges[edges > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(self.offsets, starts, "right") - 1
        return Words(starts, ends, row, np.searchsorted(starts, self.offsets, "left"))

    def per_row(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each row are marked."""
        sums = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[Chunk]:
    """The rows of a string column by chunks; a row is never split."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right")) - 1)
        own = offsets[at : to + 1]
        yield Chunk(at, own - own[0], data[own[0] : own[-1]])
        at = to


def code_points(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each code point."""
    return (data & 0xC0) != 0x80


def same_before(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: does an earlier one of its row have its value; does any other."""
    order = np.lexsort((value, row))
    equal = np.zeros(len(order) + 1, bool)
    if len(order):
        r, v = row[order], value[order]
        equal[1:-1] = (r[1:] == r[:-1]) & (v[1:] == v[:-1])
    earlier, any_other = np.empty(len(order), bool), np.empty(len(order), bool)
    earlier[order] = equal[:-1]
    any_other[order] = equal[:-1] | equal[1:]
    return earlier, any_other


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Marks what windows of the width at the starts cover, of n elements."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0
