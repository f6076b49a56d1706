"""Words of many texts at once, as numpy arrays: places in the UTF-8 bytes and 64-bit hashes.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return. Hashes are sums of random byte
values times powers of an odd number, modulo 2**64, then mixed; they depend on the word alone, on every machine. Work arrays cover at
most about ``CHUNK`` bytes, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Powers:
    up = _powers(_BASE, CHUNK)
    down = _powers(_INVERSE, CHUNK)

    @classmethod
    def reach(cls, n: int) -> None:
        if n > len(cls.up):
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of consecutive texts: text number, first byte, byte after the last, hash; and the bytes they lie in."""
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray
    texts: int

    def first(self) -> np.ndarray:
        """Where each text's words begin in these arrays, and the total at the end."""
        return np.searchsorted(self.doc, np.arange(self.texts + 1))

    def text(self, i: int) -> str:
        return self.data[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls are empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return places, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def split(texts: pa.Array, lower: bool = False) -> Words:
    offsets, data = flat(texts)
    low, high = int(offsets[0]), int(offsets[-1])
    data = data[low:high]
    if lower:
        data = _LOWER[data]
    offsets = offsets - low
    n = high - low
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), data, len(texts))
    inside = ~_SPACE[data]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | border[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | border[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    del inside, begins, ends, border
    hashes = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        first = int(start[at])
        to = max(int(np.searchsorted(end, first + CHUNK, "right")), at + 1)
        last = int(end[to - 1])
        _Powers.reach(last - first)
        sums = np.zeros(last - first + 1, dtype=np.uint64)
        np.cumsum(_VALUES[data[first:last]] * _Powers.up[:last - first], dtype=np.uint64, out=sums[1:])
        s, e = start[at:to] - first, end[at:to] - first
        hashes[at:to] = mix((sums[e] - sums[s]) * _Powers.down[s] + (e - s).astype(np.uint64))
        at = to
    # the text of a word: the last one that begins at or before it (empty texts share their offset with the next)
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, hashes, data, len(texts))


def parts(batch: pa.RecordBatch, column: str, limit: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    offsets, _ = flat(batch.column(batch.schema.names.index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield batch.slice(at, to - at)
        at = to


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive values (empty where there are fewer)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + values[k:k + n]
    return mix(total)
