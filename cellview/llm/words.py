"""Array-wise tokenising and hashing of whole Arrow text columns.

Words are found on the UTF-8 bytes of a batch at once.  A word's hash is a
polynomial over random byte codes modulo 2**64, taken from one running sum, so
no Python code runs per word.  Two different words share a hash with a chance
of about 2**-58; the operators take the hash for the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # working memory is about 60 bytes per byte of a slice
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters that are neither letters nor digits part words too
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)[LOWER]

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(n, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers = tables[0], tables[1]
    return _powers


@dataclass
class Tokens:
    """Words of a run of texts: ``rows[first:last]`` of the batch."""

    first: int
    last: int
    data: np.ndarray  # bytes of all texts
    start: np.ndarray  # of each word
    end: np.ndarray  # exclusive
    hash: np.ndarray  # uint64
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]

    @property
    def rows(self) -> int:
        return self.last - self.first

    def owner(self) -> np.ndarray:
        """Text index of each word, from 0."""
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes, or one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def tokens(column: pa.Array, parts: np.ndarray = BLANK) -> Iterator[Tokens]:
    """Words of a text column, lower-cased in A-Z, slice by slice.

    Texts without words have an empty range in ``bounds``.
    """
    data, offsets = texts_of(column)
    for first, last in slices(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        own = data[lo:hi]
        begins = offsets[first : last + 1] - lo
        n = len(own)
        if not n:
            empty = np.zeros(0, np.int64)
            yield Tokens(first, last, own, empty, empty, np.zeros(0, np.uint64), np.zeros(last - first + 1, np.int64))
            continue
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~parts[own]
        fresh = np.zeros(n + 1, dtype=bool)
        fresh[begins] = True
        fresh = fresh[:n]
        start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | fresh))
        ends_here = np.append(fresh[1:], True)
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | ends_here)) + 1
        power, inverse = _power_tables(n + 1)
        running = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_CODES[own] * power[:n], out=running[1:])
        h = (running[end] - running[start]) * inverse[start]
        h = mix(h + (end - start).astype(np.uint64))
        yield Tokens(first, last, own, start, end, h, np.searchsorted(start, begins))


def _run(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position in ``at``."""
    total = np.full(len(at), n, dtype=np.uint64)
    for k in range(n):
        total = mix(total * _BASE + hashes[at + k])
    return total


def windows(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words and their text; a shorter text gives its
    whole sequence as one run, a text without words none."""
    counts = np.diff(t.bounds)
    if not len(t.hash):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    padded = np.concatenate([t.hash, np.zeros(n, np.uint64)])
    owner = t.owner()
    left = np.repeat(t.bounds[1:], counts) - np.arange(len(t.hash))  # words from here to the end of the text
    full = left >= n
    hashes, owners = [_run(padded, np.flatnonzero(full), n)], [owner[full]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        hashes.append(_run(padded, t.bounds[:-1][short], k))
        owners.append(short)
    return np.concatenate(hashes), np.concatenate(owners)


def distinct(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once per text, by text and then by hash."""
    order = np.lexsort((hashes, owners))
    h, o = hashes[order], owners[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[keep], o[keep]


def crc32_of(ids: pa.Array) -> np.ndarray:
    """CRC-32 of the decimal text of each id; null counts as empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()], dtype=np.int64)
