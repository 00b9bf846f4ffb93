"""Content-defined anchors: for every string of ``WIDTH`` bytes, the k-mer in it that hashes lowest.

Equal strings have equal anchors at equal offsets, wherever they stand. All starts whose strings share an anchor are a
range, and the bytes these strings cover are the anchor's context.

k-mer hashes are fast and can be made to collide: they choose anchors and deal contexts out, where a collision costs time
and nothing else. What is taken for equal is told by digests of 128 bits, or by the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

WIDTH = 100
K = 32
BASE = 0x9E3779B97F4A7C15 | 1
WORD = (1 << 64) - 1


def byte_values(seed: int = 20_240_229) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


VALUES = byte_values()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ x >> np.uint64(29)
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


def kmer_hashes(x: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of the k bytes (a power of two) from each position."""
    h, size = VALUES[x], 1
    while size < k:
        h = h[:-size] * np.uint64(pow(BASE, size, 1 << 64)) + h[size:]
        size *= 2
    return mix(h)


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Position of the lowest, leftmost, of the w values from each position."""
    value, index, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        less = value[step:] < value[: len(value) - step]
        value = np.where(less, value[step:], value[: len(value) - step])
        index = np.where(less, index[step:], index[: len(index) - step])
        size += step
    return index


def context_digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """BLAKE2b digests of raw[start:end] for each pair, as two numbers each: equal digests tell equal bytes."""
    digest = blake2b
    return np.frombuffer(b"".join([digest(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), "<u8").reshape(-1, 2)


def context_hashes_of(x: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
    """Hash of x[start:end] for several arrays of pairs, by which to sift, not to tell equal bytes; ranges that leave x get some value."""
    powers = np.full(len(x) + 1, BASE, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    inverse = np.full(len(x) + 1, pow(BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(VALUES[x] * powers[1:], out=sums[1:])
    for start, end in ranges:
        start, end = start.clip(0, len(x)), end.clip(0, len(x))
        yield mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def anchors(rows: list[bytes], width: int = WIDTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all anchors of the rows: row, first start, last start (in the row), k-mer hash and context digest."""
    sizes = np.array([len(r) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    raw = b"".join(rows)
    x = np.frombuffer(raw, np.uint8)
    none = np.zeros(0, np.int64)
    if len(x) < width:
        return none, none, none, none.astype(np.uint64), np.zeros((0, 2), np.uint64)
    h = kmer_hashes(x, k)
    at = window_argmin(h, width - k + 1)
    row = np.repeat(np.arange(len(rows)), sizes)[: len(at)]
    good = np.arange(len(at)) + width <= ends[row]
    starts = np.flatnonzero(good)
    if not len(starts):
        return none, none, none, none.astype(np.uint64), np.zeros((0, 2), np.uint64)
    at, row = at[starts], row[starts]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    lo, hi = starts[new], starts[last]
    return row[new], lo - begins[row[new]], hi - begins[row[new]], h[at[new]], context_digests(raw, lo, hi + width)
