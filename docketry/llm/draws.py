"""Exact hypergeometric draws for populations of any size."""

from __future__ import annotations

import numpy as np

#: numpy's own generator takes smaller populations than this.
_NUMPY_BELOW = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among ``n`` drawn from ``good`` and ``bad`` ones, by inversion around the mode.

    Neighbouring probabilities have an exact ratio.  Beyond 40 standard deviations (and 60 more) lies less than a
    double can tell from nothing.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(40 * (n * share * (1 - share) * max(1, total - n) / max(1, total - 1)) ** 0.5) + 60
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)  # from k to k + 1
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weights = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(weights - weights[mode - first])
    sums = np.cumsum(weights)
    return first + min(int(np.searchsorted(sums, rng.random() * sums[-1], side="right")), last - first)


def multivariate_hypergeometric(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among ``n`` drawn from ``counts``."""
    if int(counts.sum()) < _NUMPY_BELOW:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out, rest, left = np.zeros_like(counts), int(n), int(counts.sum())
    for j, have in enumerate(counts.tolist()):
        left -= have
        out[j] = hypergeometric(rng, have, left, rest)
        rest -= int(out[j])
    return out
