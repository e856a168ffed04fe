"""Poisson bootstrap: every record gets its replicate weights from a hash, so no resampling pass is needed."""

from __future__ import annotations

import numpy as np

# Cumulative law of a Poisson(1) count, from its definition.
_PMF = np.exp(-1.0) / np.cumprod(np.maximum(np.arange(0, 17), 1))
_CDF = np.cumsum(_PMF)


# The same law as thresholds of a 64-bit number.
_THRESHOLDS = [np.uint64(min(int(c * 2.0**64), 2**64 - 1)) for c in _CDF]


def poisson_weights(keys: np.ndarray, repeats: int, seed: int, start: int = 0) -> np.ndarray:
    """records x repeats counts, from replicate `start` on; the same record always gets the same counts."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] + np.uint64(0x9E3779B97F4A7C15) * (
            np.arange(start + 1, start + repeats + 1, dtype=np.uint64)[None, :] + np.uint64(seed) * np.uint64(1_000_003)
        )
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    counts = np.zeros(x.shape, dtype=np.int8)
    for t in _THRESHOLDS:
        above = x >= t
        if not above.any():
            break
        counts += above
    return counts.astype(float)


def replicate_sums(keys: np.ndarray, values: np.ndarray, repeats: int, seed: int, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of the rows of values and total weights per replicate, a block of replicates at a time."""
    sums, counts = np.zeros((repeats, values.shape[1])), np.zeros(repeats)
    for start in range(0, repeats, block):
        w = poisson_weights(keys, min(block, repeats - start), seed, start)
        sums[start : start + block] = w.T @ values
        counts[start : start + block] = w.sum(0)
    return sums, counts


def interval(samples: np.ndarray) -> tuple[float, float]:
    lo, hi = np.quantile(samples, [0.025, 0.975])
    return float(lo), float(hi)
