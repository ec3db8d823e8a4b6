"""Vectorised scanning of Arrow text batches: words, hashes and word shingles as numpy arrays.

Every function works on whole texts; a null text counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_PRIME = U64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 18

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; makes every output bit depend on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    up = np.full(_BLOCK + 1, _PRIME)
    up[0] = 1
    down = np.full(_BLOCK + 1, U64(pow(int(_PRIME), -1, 1 << 64)))
    down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span data[start:end); spans are sorted by start. Equal bytes give equal hashes."""
    global _UP, _DOWN
    if _UP is None:
        _UP, _DOWN = _powers()
    out = np.empty(len(starts), U64)
    at, n = 0, len(starts)
    while at < n:
        lo = int(starts[at])
        to = int(np.searchsorted(starts, lo + _BLOCK // 2))
        s, e = starts[at:to], ends[at:to]
        hi = int(e.max())
        if hi - lo > _BLOCK:  # a span longer than a block is hashed by itself
            long = np.flatnonzero(e - lo > _BLOCK)
            for i in long:
                out[at + i] = _long_hash(data[s[i] : e[i]])
            fits = np.flatnonzero(e - lo <= _BLOCK)
            if len(fits):
                out[at + fits] = _block_hash(data[lo : int(e[fits].max())], s[fits] - lo, e[fits] - lo)
        else:
            out[at:to] = _block_hash(data[lo:hi], s - lo, e - lo)
        at = to
    return mix(out)


def _block_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * _UP[: len(data)], out=total[1:])
    return (total[e] - total[s]) * _DOWN[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)


def _long_hash(data: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for i in range(0, len(data), _BLOCK):
        part = data[i : i + _BLOCK]
        total += int(((part.astype(U64) + U64(1)) * _UP[: len(part)]).sum(dtype=U64)) * scale
        scale = scale * int(_UP[_BLOCK]) % (1 << 64)
    return U64((total + len(data) * 0xD6E8FEB86659FD93) % (1 << 64))


class Texts:
    """A run of texts: their UTF-8 bytes one after another and the byte offset of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def spans(self, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte and text index of each maximal run of bytes that aren't in breaks."""
        inside = ~breaks[self.data]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cut = self.offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(self.data))]
        start[cut] = inside[cut]
        end[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def words(self, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and offsets of each text's words in that array."""
        starts, ends, owner = self.spans(breaks)
        return span_hashes(self.data, starts, ends), np.searchsorted(owner, np.arange(len(self) + 1))


def texts(column: pa.Array | pa.ChunkedArray, lower: bool = True, block: int = 1 << 20) -> Iterator[Texts]:
    """The column in runs of about block bytes (a longer text is a run of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        to = min(to, len(column))
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def shingles(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of size words, and offsets by text. A text of fewer words has one shingle of them all, an empty one none."""
    n = np.diff(offsets)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(n)), counts)
    first = offsets[:-1][owner] + np.arange(out_offsets[-1]) - out_offsets[:-1][owner]
    last = offsets[1:][owner]
    padded = np.concatenate([words, np.zeros(size, U64)])
    total = np.zeros(len(owner), U64)
    for j in range(size):
        at = first + j
        total = mix(total * _PRIME + np.where(at < last, padded[at], U64(j + 1)))
    return total, out_offsets
