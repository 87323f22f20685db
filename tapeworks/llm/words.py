"""Words of many texts at once as numpy arrays: positions, hashes, hashes of runs of words.

White space is ASCII only (0x20, 0x09-0x0D), so words can be cut in the UTF-8 bytes: those bytes never
occur inside another character. A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; numpy needs about 60 bytes for each.
SLICE_BYTES = 1 << 20

_SEED = np.random.default_rng(20240917)
BYTE_VALUES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE, LENGTH, PAIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(33))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal runs have equal hashes wherever they stand.

    Every value is mixed with its place before it is added up: sums over powers of a base modulo 2^64 would
    collide for texts that somebody makes for it (two symbols in the order of Thue and Morse), whatever the base.
    """
    counts = ends - starts
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts)
    mixed = mix(values[place + np.repeat(starts, counts)] + place.astype(np.uint64) * PLACE)
    sums = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + counts.astype(np.uint64) * LENGTH)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` neighbouring values, from hashes of 1, 2, 4 ... of them, mixed pair by pair."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = min(len(a), len(b))
        return mix(a[:n] * PAIR ^ mix(b[:n] + PLACE))

    out, done, span, level = None, 0, 1, values
    while True:
        if width & span:
            out, done = level if out is None else pair(out, level[done:]), done + span
        if 2 * span > width:
            return out[: max(0, len(values) - width + 1)]
        level, span = pair(level, level[span:]), 2 * span


@dataclass
class Words:
    """The words of some texts, in order; ``text`` is the index of each word's text."""

    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # where each text starts in data, and the end of the last
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the number of words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return run_hashes(BYTE_VALUES[self.data], self.start, self.end)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``width`` words inside one text."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: n - width + 1] == self.text[width - 1 :])
        return at, window_hashes(hashes, width)[at]

    def whole(self, hashes: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of each text."""
        return run_hashes(hashes, self.first[:-1], self.first[1:])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its texts; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def find_words(column: pa.Array, lower: bool = False) -> Words:
    """Cut texts into words; with ``lower`` A-Z become a-z first."""
    data, bounds = text_bytes(column)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = ~inside
    ends[1:] &= inside[:-1]
    ends[0] = False
    # the border between two texts ends a word and may start one
    borders = bounds[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    starts[borders] = inside[borders]
    ends[borders] = inside[borders - 1]
    start, end = np.flatnonzero(starts[:-1]), np.flatnonzero(ends)
    first = np.searchsorted(start, bounds)
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(first))
    return Words(data, bounds, start, end, text, first)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts hold about ``size`` bytes; a longer text comes alone."""
    _, bounds = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def batch_of(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A batch from arrays or sequences, in the types of ``schema``."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    arrays = [c if c.type == f.type else c.cast(f.type) for c, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
