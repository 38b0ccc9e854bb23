"""Words of a whole column of texts at once: places and hashes from its bytes, without a string
or an object per word.

A byte is part of a word, a blank, or a stop (a border of pieces). The hash of a word is a
polynomial over its folded bytes modulo 2 ** 64, read off prefix sums and mixed at the end, so
its cost does not depend on the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time; a piece is cut between words only.
CHUNK = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF93  # 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


class Powers:
    """Powers of an odd base and of its inverse, kept by each worker up to the longest use so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = 1 << n.bit_length()
            grown = lambda base: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]))
            cls.up, cls.down = grown(_BASE), grown(_INVERSE)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    Powers.upto(len(values))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * Powers.up[: len(values)], dtype=np.uint64)])


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end) of the sequence behind ``sums``; equal runs hash equal wherever they are."""
    return mix((sums[end] - sums[start]) * Powers.down[start] ^ _ODD)


@dataclass(frozen=True)
class Alphabet:
    """``fold`` maps bytes, ``kind`` is 0 for the bytes of words, 1 for blanks and 2 for stops."""

    fold: bytes
    kind: bytes


def alphabet(blanks: bytes, stops: bytes = b"", lower: bool = False) -> Alphabet:
    kind = bytes(1 if b in blanks else 2 if b in stops else 0 for b in range(256))
    return Alphabet(bytes(range(256)).lower() if lower else bytes(range(256)), kind)


@dataclass
class Words:
    """``row`` of the column, byte ``start`` and ``end`` in its data, stops of the column before it,
    hash; ``carried`` marks the end of an earlier stretch."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    stop: np.ndarray
    h: np.ndarray
    carried: bool = False


class Column:
    """The data of an Arrow column of strings; NULL is an empty text."""

    def __init__(self, column: pa.Array, letters: Alphabet):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        _, offsets, data = column.buffers()
        self.offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        self.kinds = np.frombuffer(letters.kind, np.uint8)
        self.values = _VALUES[np.frombuffer(letters.fold, np.uint8)]

    def words(self) -> Iterator[Words]:
        at, stops = int(self.offsets[0]), 0
        while at < self.offsets[-1]:
            end = self._cut(at + CHUNK)
            part = self.data[at:end]
            kind = self.kinds[part]
            word = kind == 0
            first, last = word.copy(), word.copy()
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            borders = self.offsets[np.searchsorted(self.offsets, at, "right") : np.searchsorted(self.offsets, end)] - at
            first[borders] |= word[borders]
            last[borders - 1] |= word[borders - 1]
            start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
            h = run_hashes(prefix_sums(self.values[part]), start, stop)
            passed = np.cumsum(kind == 2)
            row = np.searchsorted(self.offsets, start + at, "right") - 1
            yield Words(row, start + at, stop + at, passed[start] + stops, h)
            at, stops = end, stops + int(passed[-1])

    def _cut(self, at: int) -> int:
        """The first border of words at or after ``at``."""
        total = int(self.offsets[-1])
        while at < total:
            row = int(self.offsets[np.searchsorted(self.offsets, at)])
            ahead = np.flatnonzero(self.kinds[self.data[at : min(at + CHUNK, row)]])
            if len(ahead):
                return at + int(ahead[0])
            if row <= at + CHUNK:
                return row
            at += CHUNK
        return total


def whole(column: pa.Array, letters: Alphabet) -> Words:
    """All words of a column."""
    parts = list(Column(column, letters).words())
    none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)]
    return Words(*(np.concatenate([getattr(p, f) for p in parts]) if parts else e for f, e in zip(("row", "start", "end", "stop", "h"), none)))
