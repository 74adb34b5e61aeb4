"""Content-defined chunking with a gear hash.

Each step shifts the hash by one bit, so its low ``bits`` depend on that many trailing bytes only: all candidate cuts
are found at once, and only the choice among them, between least and most bytes, is sequential.
"""

from __future__ import annotations

import numpy as np

GEAR = np.random.default_rng(20).integers(0, 1 << 63, size=256, dtype=np.uint64)
LEAST, MOST, BITS = 8 << 10, 256 << 10, 16


def candidates(data: bytes, bits: int = BITS, table: np.ndarray = GEAR) -> np.ndarray:
    """Ends of bytes after which the hash has ``bits`` low zero bits; needs ``bits`` bytes before."""
    g = table[np.frombuffer(data, dtype=np.uint8)]
    if len(g) < bits:
        return np.zeros(0, dtype=np.int64)
    total = np.zeros(len(g) - bits + 1, dtype=np.uint64)
    for k in range(bits):
        total += g[bits - 1 - k : len(g) - k] << np.uint64(k)
    return np.flatnonzero(total & np.uint64((1 << bits) - 1) == 0) + bits


def cuts(data: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[tuple[int, int]]:
    """(start, length) of the chunks: the first candidate ``least`` bytes on, else ``most`` bytes."""
    if least < bits or most < least:
        raise ValueError("bits <= least <= most")
    ends = candidates(data, bits)
    out, start = [], 0
    while start < len(data):
        k = int(np.searchsorted(ends, start + least))
        end = int(ends[k]) if k < len(ends) else len(data)
        end = min(end, start + most, len(data))
        out.append((start, end - start))
        start = end
    return out
