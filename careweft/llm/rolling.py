"""Hashes of all windows of a byte string, in numpy.

A prefix sum of (random number of the byte) * BASE**place, modulo 2**64, gives the hash of any
window by one subtraction and one product, then the bits are mixed. Tables are drawn
from a fixed seed: equal windows have equal hashes in every task.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.default_rng(20240501)
_BYTES = _SEED.integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; kept and grown by doubling."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.full(size, base, "u8")
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums before each place; one longer than `data` (last axis)."""
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), "u8")
    np.cumsum(_BYTES[data] * powers(_BASE, data.shape[-1]), axis=-1, out=out[..., 1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[start:end]."""
    shift = powers(_INVERSE, len(sums))[starts]
    return mix((sums[ends] - sums[starts]) * shift + (ends - starts).astype("u8"))
