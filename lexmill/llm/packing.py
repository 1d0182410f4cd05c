"""Arrays of whole numbers packed into one binary value, for rows that carry many of them."""

from __future__ import annotations

import numpy as np
import zstandard


def _least(a: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them; other kinds stay."""
    if a.dtype.kind not in "iu":
        return a
    top = int(a.max(initial=0))
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max), copy=False)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Pack arrays of non-negative numbers byte plane after byte plane, so that high zeros compress."""
    head, body = [], []
    for a in map(_least, map(np.asarray, arrays)):
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    text = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(text).to_bytes(4, "little") + text + b"".join(body))


def unsqueeze(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for part in raw[4:at].decode().split(","):
        kind, n = part.rsplit(":", 1)
        size = np.dtype(kind).itemsize * int(n)
        planes = np.frombuffer(raw, dtype=np.uint8, count=size, offset=at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; ``unstep`` turns them back."""
    return np.diff(values, prepend=values.dtype.type(0))


def unstep(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64)
