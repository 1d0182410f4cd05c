"""Sorted hash arrays: bounded lookup tables that tasks probe with whole arrays of keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix(code: np.ndarray) -> np.ndarray:
    h = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def order_of(x: np.ndarray) -> np.ndarray:
    """An order that sorts unsigned numbers: one plain sort of their leading bits with their places behind them."""
    if not len(x):
        return np.zeros(0, np.int64)
    bits = max(len(x) - 1, 1).bit_length()
    cut = max(int(x.max()).bit_length() + bits - 64, 0)
    packed = x >> np.uint64(cut) << np.uint64(bits) | np.arange(len(x), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    if cut:
        found = x[order]
        if (found[1:] < found[:-1]).any():  # numbers that differ only in the bits left out
            return np.argsort(x, kind="stable")
    return order


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct numbers, a place of each, which of them stands at each place) of unsigned numbers."""
    order = order_of(x)
    found = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = found[1:] != found[:-1]
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = np.cumsum(new) - 1
    return found[new], order[new], inverse


class HashArray:
    """A sorted array of hashed keys, an index of the hashes' leading bits, and a row of values per key."""

    def __init__(self, code: np.ndarray, values: np.ndarray):
        order = np.argsort(mix(code))
        self.keys, self.values = code[order], values[order].astype(np.float32)
        self._index()

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.keys, self.values = state
        self._index()

    def _index(self) -> None:
        """Made anew where the array arrives, so that only keys and values travel."""
        code, h = self.keys, mix(self.keys)
        self.bits = min(22, max(12, len(code).bit_length() + 1))
        self.h = np.append(h, np.uint64(2**64 - 1))
        edges = np.searchsorted(self.h[:-1], np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits))
        self.start = edges.astype(np.int32)
        self.most = int(np.diff(np.append(edges, len(code))).max(initial=1))

    def find(self, code: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is absent."""
        h = mix(code)
        at = self.start[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        first = self.h[at]
        row = np.where(first == h, at, -1)
        todo = np.flatnonzero(first < h)
        for step in range(1, self.most):
            i = np.minimum(at[todo] + step, len(self.h) - 1)
            hit = self.h[i] == h[todo]
            row[todo[hit]] = i[hit]
            todo = todo[~hit & (self.h[i] < h[todo])]
            if not len(todo):
                break
        row[row >= len(self.values)] = -1
        return row

    def get(self, code: np.ndarray, default: float) -> np.ndarray:
        """The single value of each key as float64."""
        row = self.find(code)
        return np.where(row >= 0, np.append(self.values, np.float32(default))[row], default).astype(np.float64)


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows whose count reaches a cutoff that at most ``most`` rows reach; found from a histogram of a few hundred rows."""
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    levels = df.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min(count).alias("least")).orderBy(F.desc("step")).collect()
    total, cutoff = 0, None
    for level in levels:
        total += level["rows"]
        if total > most:
            break
        cutoff = level["least"]
    return df.filter(F.lit(False) if cutoff is None else F.col(count) >= cutoff)
