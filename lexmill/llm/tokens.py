"""Vectorised word hashes of many texts at once, for operators that run NumPy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(7)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MORE = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
#: Bytes of text handled at a time, and bytes hashed at a time, which stay in the cache.
CHUNK = 1 << 21
BLOCK = 1 << 15


def _powers(n: int, cache: list = []) -> np.ndarray:  # noqa: B006
    if not cache or len(cache[0]) < n:
        cache[:] = [np.cumprod(np.full(max(n, 1024), _STEP))]
    return cache[0]


def _powers_back(n: int, cache: list = []) -> np.ndarray:  # noqa: B006
    if not cache or len(cache[0]) < n:
        cache[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, 1024), _BACK))))]
    return cache[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MORE
    return h ^ (h >> np.uint64(29))


def hash_runs(solid: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; the runs of the given lengths follow each other in ``solid``."""
    if not len(length):
        return np.zeros(0, np.uint64)
    offset = np.cumsum(length) - length
    place = np.arange(len(solid)) - np.repeat(offset, length)
    values = _BYTES[solid] * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(values, offset) + length.astype(np.uint64))


def hash_spans(raw: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``hash_runs`` of spans in order that lie anywhere in ``raw``: differences of running sums, block by block."""
    out, start = np.empty(len(first), np.uint64), 0
    while start < len(first):
        stop = max(int(np.searchsorted(first, first[start] + BLOCK)), start + 1)
        low, high = int(first[start]), int(first[stop - 1] + length[stop - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTES[raw[low:high]] * _powers(high - low)[: high - low], out=sums[1:])
        at = first[start:stop] - low
        out[start:stop] = (sums[at + length[start:stop]] - sums[at]) * _powers_back(high - low)[at]
        start = stop
    return mix(out + length.astype(np.uint64))


def hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, length) of every word of lower-cased bytes: words are runs without white space."""
    solid = np.zeros(len(raw) + 2, dtype=bool)
    solid[1:-1] = (raw != 0x20) & (raw - np.uint8(0x09) > 4)
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    first, length = edges[::2], edges[1::2] - edges[::2]
    return hash_spans(raw, first, length), first, length


def word_chunks(texts) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts of about CHUNK bytes: (indices, hashes, bounds of each text's words, bytes, first byte, length)."""
    picked, parts, size = [], [], 0

    def done():
        raw = np.frombuffer(b" ".join(parts).lower(), dtype=np.uint8)
        h, first, length = hash_words(raw)
        ends = np.cumsum([len(p) + 1 for p in parts])
        return picked, h, np.concatenate(([0], np.searchsorted(first, ends))), raw, first, length

    for i, text in enumerate(texts):
        part = (text or "").encode()
        if parts and size + len(part) > CHUNK:
            yield done()
            picked, parts, size = [], [], 0
        picked.append(i)
        parts.append(part)
        size += len(part) + 1
    if parts:
        yield done()


def shingle_sets(texts, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct 64-bit shingle hashes) of each text; a shorter text is one shingle."""
    for picked, h, bounds, *_ in word_chunks(texts):
        rolled = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            rolled = rolled * _STEP + h[k : k + len(rolled)]
        rolled = mix(rolled)
        for j, i in enumerate(picked):
            a, b = int(bounds[j]), int(bounds[j + 1])
            if b - a >= width:
                yield i, np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.zeros(1, dtype=np.uint64)
                for x in h[a:b]:
                    whole = whole * _STEP + x
                yield i, mix(whole + np.uint64(b - a))
            else:
                yield i, np.zeros(0, dtype=np.uint64)
