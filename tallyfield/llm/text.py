"""Vectorised handling of words inside Arrow batches: boundaries, 64-bit word hashes, word shingles.

Words are runs of bytes other than blank and 0x09-0x0D. A batch of texts is one byte buffer with offsets; nothing here
loops over words or characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # texts are worked on in pieces of about this many bytes; a longer text is one piece
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: a bijection whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
STEP_CODES = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)]) for b in (_BASE, _BASE_INVERSE))
    return up, down


class _PowerTable:
    """Powers of the hash base and of its inverse modulo 2^64. It travels empty and is filled once in each task."""

    def __init__(self) -> None:
        self.size, self.tables = -1, None

    def __reduce__(self):
        return _PowerTable, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(CHUNK_BYTES * 2, 1 << max(n, 1).bit_length())
            self.tables = _powers(self.size)
        return self.tables


_POWER_TABLE = _PowerTable()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n + 1 powers of the hash base and of its inverse."""
    return _POWER_TABLE.upto(n)


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column as (first row, bytes, offsets of its rows and the end). NULL reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, raw[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the row it belongs to."""
    if buf.size == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~WHITE[buf]
    edge = np.zeros(buf.size + 1, dtype=bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    up, down = powers(buf.size)
    with np.errstate(over="ignore"):
        running = np.zeros(buf.size + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[buf] * up[:buf.size], out=running[1:])
        value = (running[ends] - running[starts]) * down[starts]
        return mix(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)))


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    if words.size < k:
        return np.zeros(0, np.uint64)
    n = words.size - k + 1
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            total += words[j:j + n] * STEP_CODES[j]
        return mix(total + np.uint64(k))


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles (A-Z lowered).

    A row with fewer words has its whole sequence as the one shingle, a row without words none.
    """
    low = LOWER[buf]
    starts, ends, rows = word_bounds(low, offsets)
    words = span_hashes(low, starts, ends) if starts.size else np.zeros(0, np.uint64)
    every = sequence_hashes(words, k)
    first = np.searchsorted(rows, np.arange(len(offsets)), side="left")
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            yield np.unique(every[a:b - k + 1])
        elif b > a:
            yield sequence_hashes(words[a:b], int(b - a))
        else:
            yield words[:0]
