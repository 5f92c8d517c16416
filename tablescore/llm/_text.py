"""Numpy kernels over the byte buffer of an Arrow string column.

Texts are never turned into Python strings here: words, n-grams and shingles are spans and 64-bit
hashes computed over the concatenated UTF-8 bytes of a batch, so a word costs nanoseconds.
Upper-case A-Z is folded while hashing; every other byte counts as it is.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that one kernel call looks at (a longer single text is taken whole).
CHUNK_BYTES = 1_000_000

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII byte that is neither a letter nor a digit.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EXACT = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = _EXACT[_LOWER]
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = np.uint64(0xD1342543DE82EF95)

#: Stands for the end of a text, and for the padding before its first word.
END, START = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


@lru_cache(maxsize=2)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def give_back() -> None:
    """Returns freed memory to the system (where the C library can): workers outlive their tasks."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte spans as they are, upper case kept."""
    power, inverse = powers(max(len(data), CHUNK_BYTES) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_EXACT[data] * power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def string_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and the n + 1 places where texts begin; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(at), np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text is a range of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


class Words:
    """The words of a batch, `[^\\x20\\x09-\\x0D]+` unless other separating bytes are given: byte
    spans, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        ink = ~apart[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before, after = edge[:-1].copy(), edge[1:].copy()
        before[1:] |= ~ink[:-1]
        after[:-1] |= ~ink[1:]
        self.starts = np.flatnonzero(ink & before)
        self.ends = np.flatnonzero(ink & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, *prefixes: int) -> np.ndarray | list[np.ndarray]:
        """Each word's hash; with prefixes, also those of its first so many bytes (all, of a shorter word)."""
        size = max(len(self.data), CHUNK_BYTES) + 1
        power, inverse = powers(size)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * power[: len(self.data)], out=sums[1:])
            begin, unit, out = sums[self.starts], inverse[self.starts], []
            for k in (None, *prefixes):
                ends = self.ends if k is None else np.minimum(self.ends, self.starts + k)
                out.append(mix((sums[ends] - begin) * unit + (ends - self.starts).astype(np.uint64)))
        return out if prefixes else out[0]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def join_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of all but its last member and the last member's."""
    with np.errstate(over="ignore"):
        return mix(left * _STEP + right)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and the n + 1 places where
    texts begin. A text of fewer words has one shingle, its whole sequence; one without words none."""
    h, first = words.hashes(), words.first
    count = np.diff(first)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    grown, tails = h.copy(), [h]
    for k in range(1, width):
        if len(h) > k:
            grown[: len(h) - k] = join_hash(grown[: len(h) - k], h[k:])
        tails.append(grown.copy() if k < width - 1 else grown)
    doc = words.doc_of()
    fits = first[1:][doc] - np.arange(len(h)) >= width
    out, of = grown[fits], doc[fits]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        with np.errstate(over="ignore"):
            own = np.array([tails[count[d] - 1][first[d]] for d in short], np.uint64) + count[short].astype(np.uint64)
        out, of = np.concatenate([out, own]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    at = np.searchsorted(of, np.arange(len(first)))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[new], np.searchsorted(of[new], np.arange(len(first)))
