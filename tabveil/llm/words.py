"""Vectorised words, word hashes and window hashes over batches of texts.

A batch of texts is handled as one byte buffer: word borders come from a byte table, and the hash of a
word is the difference of two prefix sums of ``byte * R**position`` (mod 2**64), shifted back to
position 0 and mixed. Cost is a few numpy passes a byte, with no Python object per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Arrow's own pool and malloc's heap keep what was freed; a worker beside a full Java heap should give it back.
pa.set_memory_pool(pa.system_memory_pool())
with contextlib.suppress(OSError, AttributeError):
    for _option in (-3, -1):  # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        ctypes.CDLL(None).mallopt(_option, 1 << 20)

U = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_W = 0xD1342543DE82EF95 | 1
_W_INV = pow(_W, -1, 1 << 64)


def separators(keep: str) -> np.ndarray:
    """A table byte -> is part of a word. keep: "space" (all but ASCII white space) or "alnum"."""
    table = np.ones(256, bool)
    if keep == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:  # 0-9, A-Z, a-z and all non-ASCII
        table[:0x80] = False
        table[0x30:0x3A] = table[0x41:0x5B] = table[0x61:0x7B] = True
    return table


SPACE, ALNUM = separators("space"), separators("alnum")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_tables: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept for each base, grown by doubling."""
    have = _tables.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], filled, step = 1, 1, base
        while filled < size:
            have[filled : 2 * filled] = have[:filled] * U(step)
            filled, step = 2 * filled, step * step % (1 << 64)
        _tables[base] = have
    return have[:n]


class Words:
    """The words of some texts. doc[i] is the text of word i; first[d] : first[d + 1] are text d's words."""

    def __init__(self, texts: list[bytes], table: np.ndarray = SPACE, lower: bool = False):
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"\n".join(texts), np.uint8)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 1, out=at[1:])
        self.text_start = at[:-1]
        if lower:
            self.buf = _LOWER[self.buf]
        inside = np.zeros(len(self.buf) + 2, np.int8)
        inside[1:-1] = table[self.buf]
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, at)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + U(1)) * powers(_R, len(self.buf)), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(_R_INV, len(self.buf))[self.start] + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def windows(word_hash: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of `size` consecutive word hashes (over the borders of texts too)."""
    n = len(word_hash)
    if n < size:
        return np.zeros(0, np.uint64)
    x = mix(word_hash + U(salt)) if salt else word_hash
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * powers(_W, n), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(_W_INV, n)[: n - size + 1])


def window_starts(words: Words, size: int) -> np.ndarray:
    """The word positions from which `size` words lie in one text."""
    if len(words) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(words.doc[: len(words) - size + 1] == words.doc[size - 1 :])


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most `limit` bytes of text, unless one text alone is longer. Null: empty.

    Only the slice at hand is copied out of its batch.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = done = 0
        while low < len(ends):
            high = max(low + 1, int(np.searchsorted(ends, done + limit, "right")))
            own = texts.slice(low, high - low)
            own = own.cast(pa.large_binary()) if pa.types.is_large_string(own.type) else own.cast(pa.binary())
            yield batch.slice(low, high - low), [x or b"" for x in own.to_pylist()]
            low, done = high, int(ends[high - 1])


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, with the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])
