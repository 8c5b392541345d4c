"""Vectorised numpy work on the bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: A chunk of texts is worked on at a time; this bounds the memory of a task, apart from one long text.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BASE = U64(0x9E3779B97F4A7C15 | 5)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n-1), modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        known = _powers[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Chunk:
    """Some consecutive texts: rows first..first+len(offsets)-2 of the batch, as bytes."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, lower: bool = False) -> Iterator[Chunk]:
    """The UTF-8 bytes of a text column, about `limit` bytes or one text at a time; null is empty.

    With lower, letters of all scripts are made lower-case first.
    """
    for part, base in _parts(column):
        part = part.cast(pa.large_string()) if not pa.types.is_large_string(part.type) else part
        part = part.fill_null("") if part.null_count else part
        _, ends, data = part.buffers()
        offsets = np.frombuffer(ends, np.int64, len(part) + 1, part.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(part):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            if lower:
                for chunk in chunks(pc.utf8_lower(part.slice(i, j - i)), max(2 * limit, 2 * int(offsets[j] - offsets[i]))):
                    yield Chunk(base + i + chunk.first, chunk.data, chunk.offsets)
            else:
                yield Chunk(base + i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j


def _parts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    base = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield part, base
        base += len(part)


@dataclass
class Words:
    """Words of a chunk: start and end byte, and for each text its first word's number."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


#: ASCII white space: blank, tab, newline, vertical tab, form feed, return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])


def words(chunk: Chunk, inside: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of bytes marked in `inside`; no word crosses two texts."""
    n = len(chunk.data)
    mark = inside[chunk.data]
    opens, closes = mark.copy(), mark.copy()
    opens[1:] &= ~mark[:-1]
    closes[:-1] &= ~mark[1:]
    cuts = chunk.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    opens[cuts] = mark[cuts]
    closes[cuts - 1] = mark[cuts - 1]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, chunk.offsets))


def prefix_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial hash: span_hashes() takes any span's hash from it."""
    table = _BYTE
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(_BASE, len(data)), out=sums[1:], dtype=np.uint64)
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes that depend only on the spans' bytes (and length)."""
    return mix64((sums[end] - sums[start]) * powers(_INVERSE, len(sums))[start] + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def ngram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word runs, and the number of each text's first one."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    m = len(hashes) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix64(out * U64(0xA0761D6478BD642F) + hashes[k : k + m])
    keep = np.ones(m, bool)
    for k in range(1, n):  # runs that would cross into the next text
        at = first[1:-1] - k
        keep[at[(at >= 0) & (at < m)]] = False
    # A text with fewer than n words has none; runs starting in it are marked by its own end above.
    return out[keep], np.concatenate([[0], np.cumsum(counts)])
