"""Mutual information by nearest neighbours."""

from __future__ import annotations

import numpy as np


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def _within(x: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How many values, each itself included, have a difference of at most a radius. Sums round, so ends are set by differences."""
    s = np.sort(x)
    n = len(s)
    low, high = np.searchsorted(s, x - radius, "left"), np.searchsorted(s, x + radius, "right")
    while True:
        drop_low = (low < n) & (x - s[np.minimum(low, n - 1)] > radius)
        take_low = (low > 0) & (x - s[np.maximum(low - 1, 0)] <= radius)
        drop_high = (high > 0) & (s[np.maximum(high - 1, 0)] - x > radius)
        take_high = (high < n) & (s[np.minimum(high, n - 1)] - x <= radius)
        if not (drop_low | take_low | drop_high | take_high).any():
            return high - low
        low += drop_low.astype(int) - (take_low & ~drop_low)
        high += take_high.astype(int) - (drop_high & ~take_high)


def prepared(x: np.ndarray, rng: np.random.RandomState) -> np.ndarray:
    """Columns by their deviations, with a trace of noise against ties."""
    scale = x.std(axis=0)
    x = x / np.where(scale > 0, scale, 1)
    return x + 1e-10 * np.maximum(1, np.abs(x).mean(axis=0)) * rng.standard_normal(size=x.shape)


def continuous(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Of two continuous variables."""
    n = len(x)
    if n <= k:
        return 0.0
    radius = np.empty(n)
    for a in range(0, n, 512):
        d = np.maximum(np.abs(x[a : a + 512, None] - x), np.abs(y[a : a + 512, None] - y))
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        radius[a : a + 512] = np.partition(d, k - 1, axis=1)[:, k - 1]
    radius = np.nextafter(radius, 0)
    value = digamma(np.array(n)) + digamma(np.array(k)) - digamma(_within(x, radius)).mean() - digamma(_within(y, radius)).mean()
    return max(0.0, float(value))


def with_class(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Of a continuous variable and a class."""
    radius, ks, counts = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        own = np.flatnonzero(y == c)
        counts[own] = len(own)
        if len(own) > 1:
            near = min(k, len(own) - 1)
            s, order = np.sort(x[own]), np.argsort(x[own], kind="stable")
            # The k-th nearest in a sorted list is the end of one of the k + 1 runs around a value.
            padded = np.concatenate([np.full(near, -np.inf), s, np.full(near, np.inf)])
            at = np.arange(len(s)) + near
            d = np.min([np.maximum(padded[at] - padded[at - near + j], padded[at + j] - padded[at]) for j in range(near + 1)], axis=0)
            radius[own[order]] = np.nextafter(d, 0)
            ks[own] = near
    keep = counts > 1
    if not keep.any():
        return 0.0
    x, radius = x[keep], radius[keep]
    value = digamma(np.array(keep.sum())) + digamma(ks[keep]).mean() - digamma(counts[keep]).mean() - digamma(_within(x, radius)).mean()
    return max(0.0, float(value))


def greedy(relevance: np.ndarray, redundancy: np.ndarray, count: int | None = None) -> list[int]:
    """Features by relevance less the mean redundancy with those before; of equal ones the first."""
    left, chosen, load = list(range(len(relevance))), [], np.zeros(len(relevance))
    for _ in range(min(count or len(relevance), len(relevance))):
        score = relevance[left] - (load[left] / len(chosen) if chosen else 0)
        best = left.pop(int(np.argmax(score)))
        chosen.append(best)
        load += redundancy[best]
    return chosen
