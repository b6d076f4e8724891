"""Keys along a Hilbert curve through any number of dimensions."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells along the curve, as rows of bytes that compare in its order.

    ``cells`` is rows by dimensions of numbers below ``2 ** bits``.  The transform is
    Skilling's (2004): from the highest bit down each axis is reflected or exchanged
    with the first, then the bits are Gray-coded and interleaved.
    """
    rows, dims = cells.shape
    if not dims:
        return np.zeros((rows, 0), np.uint8)
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    for bit in range(bits - 1, 0, -1):
        low = np.uint32((1 << bit) - 1)
        for i in range(dims):
            reflect = (x[i] >> bit) & 1 == 1
            exchanged = np.where(reflect, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(reflect, low, exchanged)
            if i:
                x[i] ^= exchanged
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turned = np.zeros(rows, np.uint32)
    for bit in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> bit) & 1 == 1, np.uint32((1 << bit) - 1), np.uint32(0))
    x ^= turned
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)
