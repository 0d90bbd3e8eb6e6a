"""Hashes of all words of an Arrow column of texts, computed on its bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[pa.Array]:
    """Consecutive parts of at most ``limit`` bytes of text, or of one longer text."""
    if not len(column):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield column.slice(at, to - at)
        at = to


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each text starts and the last one ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    size = len(column) + 1
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + size]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True
) -> np.ndarray:
    """64-bit hash of each word, A-Z taken as a-z if ``lower``; equal words have equal hashes."""
    values = _VALUES[_LOWER[data]] if lower else _VALUES[data]
    out = np.zeros(len(starts), dtype=np.uint64)
    lengths = ends - starts
    with np.errstate(over="ignore"):
        left = np.arange(len(starts))
        for step in range(int(lengths.max(initial=0))):
            left = left[lengths[left] > step]
            if 64 * len(left) < len(starts) or step >= 64:
                # Few long words are left: hash the rest of each at once.
                for i in left:
                    rest = values[starts[i] + step : ends[i]]
                    powers = np.multiply.accumulate(np.full(len(rest), _BASE))
                    below = np.concatenate((powers[-2::-1], [np.uint64(1)]))
                    out[i] = out[i] * powers[-1] + (rest * below).sum()
                break
            out[left] = out[left] * _BASE + values[starts[left] + step]
        return mix(out ^ mix(lengths.astype(np.uint64)))


def windows(
    hashes: np.ndarray, first: np.ndarray, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words, its text, and the number of runs of each text.

    A text with fewer words, but at least one, has its whole sequence as its one run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    texts = np.repeat(np.arange(len(counts)), runs)
    begin = np.cumsum(runs) - runs
    at = np.arange(len(texts)) - begin[texts] + first[:-1][texts]
    length = np.minimum(counts, size)[texts]
    out = length.astype(np.uint64)
    with np.errstate(over="ignore"):
        for step in range(size):
            on = length > step
            out[on] = mix(out[on] * _BASE + hashes[at[on] + step])
    return out, texts, runs
