"""Whole texts as numpy bytes, straight from Arrow buffers.

Every helper works on a slice of a record batch: consecutive rows whose texts
hold at most ``SLICE_BYTES`` together (a longer text is a slice of its own), so
memory follows one slice, not the batch.  A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_POWERS: dict[str, np.ndarray] = {}


def as_bytes(column: pa.Array) -> pa.LargeBinaryArray:
    """Text column -> large binary without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them."""
    column = as_bytes(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch whose texts hold at most ``limit`` bytes, or one row."""
    _, offsets = buffer(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(to, at + 1))
        yield batch.slice(at, to - at)
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        m = max(n, SLICE_BYTES + 8)
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(m, base, np.uint64)
            table[0] = 1
            _POWERS[key] = np.cumprod(table, dtype=np.uint64)
    up, down = _POWERS["up"][:n], _POWERS["down"][:n]
    if n > 4 * SLICE_BYTES:  # one very long text: don't keep its table
        _POWERS.clear()
    return up, down


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Spans:
    """Runs of bytes of one class within each text: start, end, text index."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> None:
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = member[data] if n else False
        first = inside[1:-1] & (~inside[:-2] | edge[:-1])
        last = inside[1:-1] & (~inside[2:] | edge[1:])
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=len(self.offsets) - 1).astype(np.int64)


class Hasher:
    """64-bit polynomial hashes of any spans of one byte buffer, by prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray) -> None:
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[:-1], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64))


def starts_of_characters(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a UTF-8 code point."""
    return (data & 0xC0) != 0x80
