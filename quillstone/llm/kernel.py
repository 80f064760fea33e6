"""Vectorised text primitives over Arrow buffers.

Everything works on the UTF-8 bytes of many texts at once: no per-word Python. A
chunk holds about `CHUNK` bytes (or one longer text), so peak memory is a few dozen
times that figure whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_SEED = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply): spreads every input bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def class_table(members) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: Bytes of a word: all but ASCII white space.
SPACE_WORDS = class_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Bytes of a word: ASCII letters and digits, and all of UTF-8 above ASCII.
ALNUM_WORDS = class_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


@lru_cache(maxsize=4)
def byte_codes(fold: bool) -> np.ndarray:
    """A fixed random 64-bit code per byte; `fold` gives A-Z the codes of a-z."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * _U(_SEED))
    if fold:
        codes = codes.copy()
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


_BASE = 0xD6E8FEB86659FD93
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        inverse, tables = pow(_BASE, -1, 1 << 64), []
        for base in (_BASE, inverse):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=np.uint64))
        _POWERS[:] = tables
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix sums of code * base**i; with `span_hash` they give the hash of any slice."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_codes(fold)[data] * up[:-1], out=out[1:], dtype=np.uint64)
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(_SEED))


class Chunk:
    """Some texts as one byte array: `data`, and `bounds` (n + 1 offsets)."""

    __slots__ = ("bounds", "data", "first")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def words(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each text the index of its first word (n + 1)."""
        inside = members[self.data]
        edge = np.empty(len(inside) + 1, dtype=bool)
        if len(inside):
            edge[0], edge[-1] = True, True
            edge[1:-1] = False
            edge[self.bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.bounds)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), bounds


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a text column into runs of whole texts of about `size` bytes."""
    data, bounds = text_buffers(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
        j = min(j, n)
        yield Chunk(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j


def shingle_hashes(chunk: Chunk, width: int, members: np.ndarray = SPACE_WORDS, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of each text and per-text offsets (n + 1).

    A text of fewer words, but not none, has one n-gram: all its words.
    """
    starts, ends, first = chunk.words(members)
    words = span_hash(prefix_hash(chunk.data, fold), starts, ends)
    counts = np.diff(first)
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    doc = np.repeat(np.arange(len(counts)), sizes)
    at = np.arange(offsets[-1]) - offsets[doc] + first[doc]
    length = np.minimum(counts[doc], width)
    out = np.full(len(at), _U(_SEED), dtype=np.uint64)
    for k in range(width):
        some = length > k
        step = np.zeros(len(at), dtype=np.uint64)
        step[some] = words[at[some] + k]
        out = mix(out * _U(0x100000001B3) + step + _U(k))
    return out, offsets


def sorted_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending values of each list, and new offsets."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[keep], doc[keep]
    return values, np.searchsorted(doc, np.arange(len(offsets)))
