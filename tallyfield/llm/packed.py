"""Unsigned 32-bit arrays as compressed bytes, for messages between chunks and buckets."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned 32-bit arrays, byte plane by byte plane, compressed."""
    head = np.array([len(arrays), *map(len, arrays)], "<u4").tobytes()
    planes = [np.ascontiguousarray(np.asarray(a).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", n, 4).tolist()
    at, out = 4 * (n + 1), []
    for size in sizes:
        planes = np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size)
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 4 * size
    return out
