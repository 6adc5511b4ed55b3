"""Vectorised text kernels shared by the corpus operators.

Every function here works on the UTF-8 bytes of a handful of documents at a
time, inside a Spark task.  ``chunks`` cuts an Arrow batch into pieces of about
``CHUNK`` bytes (a longer document is a piece of its own), so that memory is
bounded by the largest document and never by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
RANKED = 40  # of a gram's 64 bits, those that winnowing compares; the others hold a position in a block
U = np.uint64

#: Word classes over bytes: what is not ASCII white space, and digits, letters and all bytes from 0x80 on.
NOT_SPACE = np.ones(256, np.bool_)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, np.bool_)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: A-Z to a-z, other bytes unchanged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Hashes of substrings by prefix sums modulo 2**64 with an odd base, so that no loop over positions is needed."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.table = mix(np.arange(256, dtype=U) + U(seed))
        self.up = self.down = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = np.full(n, U(self.base)), np.full(n, U(self.inverse))
            self.up[0] = self.down[0] = U(1)
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than the symbols (uint64, or bytes, which go through the table)."""
        n = len(symbols)
        self._grow(n + 1)
        out = np.zeros(n + 1, U)
        np.cumsum((self.table[symbols] if symbols.dtype == np.uint8 else symbols) * self.up[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(U))

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """The hash of each k consecutive symbols."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.down[:n] + U(k)) if n > 0 else np.zeros(0, U)


BYTES = Roller(0x9E3779B97F4A7C15, 1)
WORDS = Roller(0xD6E8FEB86659FD93, 2)
OTHER = Roller(0xA0761D6478BD642F, 3)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, their bytes, offsets of the rows in these) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK, "right")) - 1)
        high = min(high, n)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and for each document the index of its first word (one more at the end)."""
    inside = np.zeros(len(buf) + 2, np.bool_)
    inside[1:-1] = kind[buf]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]  # a word ends where its document ends
    both = cut[inside[cut] & inside[cut + 1]]
    begins[both] = True
    ends[both - 1] = True
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return BYTES.spans(BYTES.prefix(buf), start, end)


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word, from the words' first indexes."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def winnow(grams: np.ndarray, gram_ok: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: for each window of w consecutive grams the position of its least gram, the rightmost of equal ones.

    Grams are compared by their upper RANKED bits, whatever piece of text they
    are in, so that equal windows of any two pieces choose the same gram.
    Returns (window starts, chosen position per window).  Only windows whose
    grams are all in one document count: gram_ok[i] is the number of grams from
    i on that its document still holds.
    """
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = 1 << 64 - RANKED
    if len(grams) > most:  # in blocks that overlap by a window
        step = most - w + 1
        parts = [(low, winnow(grams[low : low + most], gram_ok[low : low + most], w)) for low in range(0, n, step)]
        return tuple(np.concatenate([part[j] + low for low, part in parts]) for j in range(2))
    mask = U(most - 1)
    key = (grams & ~mask) | (mask - np.arange(len(grams), dtype=U))
    have, low = 1, key
    while have * 2 <= w:  # minima over windows of doubling width
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < w:
        low = np.minimum(low[:n], low[w - have : w - have + n])
    starts = np.flatnonzero(gram_ok[:n] >= w)
    return starts, (mask - (low[starts] & mask)).astype(np.int64)


def left_in_document(first: np.ndarray, k: int) -> np.ndarray:
    """For each symbol, how many k-grams start at it or later in its document."""
    n = int(first[-1])
    last = np.repeat(first[1:], np.diff(first))
    return np.maximum(0, last - np.arange(n) - k + 1)


def inside(first: np.ndarray, length: int) -> np.ndarray:
    """For each symbol, whether `length` symbols from it on are in its document."""
    ok = np.ones(int(first[-1]), np.bool_)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        ok[max(low, high - length + 1) : high] = False
    return ok


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans as disjoint sorted ones; touching spans join."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]
