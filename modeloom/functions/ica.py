"""Independent components by symmetric FastICA, and a two-Gaussian threshold."""

from __future__ import annotations

import numpy as np


def fast_ica(x: np.ndarray, seed: int = 42, max_iter: int = 1000, tol: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Sources and the mixing matrix of channels x samples with their means removed."""
    sources, mixing = fast_ica_of_many(x[None], seed, max_iter, tol)
    return sources[0], mixing[0]


def fast_ica_of_many(x: np.ndarray, seed: int = 42, max_iter: int = 1000, tol: float = 1e-4) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The same of recordings x channels x samples, each by itself: those that still move take a step together."""
    n = x.shape[2]
    centred = x - x.mean(axis=2, keepdims=True)
    u, d, _ = np.linalg.svd(centred, full_matrices=False)
    live = d > d.max(axis=1, initial=0)[:, None] * 1e-10
    sources, mixing = [np.zeros((0, n))] * len(x), [np.zeros((x.shape[1], 0))] * len(x)

    def even(w: np.ndarray) -> np.ndarray:
        s, v = np.linalg.eigh(w @ w.swapaxes(1, 2))
        return (v / np.sqrt(np.maximum(s, 1e-12))[:, None, :]) @ v.swapaxes(1, 2) @ w

    # Singular values fall, so of as many live ones the first are.
    for c in np.unique(live.sum(axis=1)):
        own = np.flatnonzero(live.sum(axis=1) == c)
        if not c:
            continue
        white_by = (u[own, :, :c] / d[own, None, :c]).swapaxes(1, 2) * np.sqrt(n)
        z = white_by @ centred[own]
        w, going = even(np.repeat(np.random.RandomState(seed).normal(size=(1, c, c)), len(own), axis=0)), np.arange(len(own))
        held = z
        for _ in range(max_iter):
            now = w[going]
            g = np.tanh(now @ held)
            new = even(g @ held.swapaxes(1, 2) / n - (1 - g**2).mean(axis=2)[:, :, None] * now)
            moved = np.abs(np.abs(np.einsum("rij,rij->ri", new, now)) - 1).max(axis=1)
            w[going] = new
            on = ~(moved < tol)
            if not on.all():
                going, held = going[on], held[on]
            if not len(going):
                break
        unmix = w @ white_by
        back = np.linalg.pinv(unmix)
        for k, s, m in zip(own, unmix @ centred[own], back, strict=True):
            sources[k], mixing[k] = s, m
    return sources, mixing


def excess_kurtosis(x: np.ndarray) -> float:
    s = x.std()
    return 0.0 if s < 1e-10 else float((((x - x.mean()) / s) ** 4).mean() - 3)


def without_artifacts(x: np.ndarray, remove: int = 2, seed: int = 42) -> np.ndarray:
    """The signal without its `remove` components of greatest kurtosis. The means aren't put back."""
    return without_artifacts_of_many(x[None], remove, seed)[0]


def without_artifacts_of_many(x: np.ndarray, remove: int = 2, seed: int = 42) -> np.ndarray:
    """The same of recordings x channels x samples."""
    out = np.zeros(x.shape)
    for k, (sources, mixing) in enumerate(zip(*fast_ica_of_many(x, seed), strict=True)):
        worst = np.argsort([abs(excess_kurtosis(s)) for s in sources], kind="stable")[len(sources) - min(remove, len(sources)) :]
        sources[worst] = 0
        out[k] = mixing @ sources
    return out


def two_gaussians(values: np.ndarray, stop: float = 1e-4, max_iter: int = 10_000) -> float:
    """The threshold of least error between a low and a high class, by expectation and maximisation.

    Iteration ends as soon as any of the six parameters moves by no more than `stop`. Without a threshold: mid-range."""
    v = np.asarray(values, float)
    middle = (v.max() + v.min()) / 2
    high, low = v[v > middle + 0.01 * (v.max() - middle)], v[v < middle - 0.01 * (middle - v.min())]
    with np.errstate(all="ignore"):
        mean, var = np.array([high.mean() if len(high) else np.nan, low.mean() if len(low) else np.nan]), np.array([high.var(ddof=1) if len(high) > 1 else 0.0, low.var(ddof=1) if len(low) > 1 else 0.0])
        prior = np.array([len(high), len(low)]) / max(1, len(high) + len(low))
        for _ in range(max_iter):
            density = np.array([np.ones_like(v) if s == 0 else np.exp(-((v - m) ** 2) / (2 * s)) / np.sqrt(2 * np.pi * s) for m, s in zip(mean, var, strict=True)])
            share = prior[:, None] * density
            share = share / share.sum(axis=0)
            new_prior = share.mean(axis=1)
            new_mean = (share * v).sum(axis=1) / (new_prior * len(v))
            new_var = (share * (v - mean[:, None]) ** 2).sum(axis=1) / (new_prior * len(v))
            moved = np.abs(np.concatenate([new_mean - mean, new_var - var, new_prior - prior]))
            mean, var, prior = new_mean, new_var, new_prior
            if not (moved > stop).all():
                break
    return border(mean, var, prior, middle)


def border(mean: np.ndarray, var: np.ndarray, prior: np.ndarray, middle: float) -> float:
    """Where two Gaussians, the higher one first, are as likely; `middle` where there is no such value."""
    with np.errstate(all="ignore"):
        a, b = (var[0] - var[1]) / 2, var[1] * mean[0] - var[0] * mean[1]
        c = np.log(prior[0] * np.sqrt(var[1]) / (prior[1] * np.sqrt(var[0]))) * var[0] * var[1] + (mean[1] ** 2 * var[0] - mean[0] ** 2 * var[1]) / 2
        root = np.sqrt(b * b - 4 * a * c)
        first, second = (-b + root) / (2 * a), (-b - root) / (2 * a)
    found = second if first < mean[1] or first > mean[0] else first
    return float(middle if np.isnan(found) else found)
