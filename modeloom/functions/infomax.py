"""Independent components by extended infomax: a natural gradient whose signs follow each component's tails."""

from __future__ import annotations

import numpy as np


def whitening(x: np.ndarray) -> np.ndarray:
    """Of centred channels x samples: live components of unit variance, turned back to the channels where all of them live."""
    values, vectors = np.linalg.eigh(x @ x.T / x.shape[1])
    live = values > max(values.max(initial=0) * 1e-10, 1e-300)
    scaled = (vectors[:, live] / np.sqrt(values[live])).T
    return vectors @ scaled if live.all() else scaled


def signs_of(u: np.ndarray) -> np.ndarray:
    """1 for components with heavy tails, -1 for those with light ones, by the switching moment."""
    t = np.tanh(u)
    return np.where(((1 - t * t).mean(axis=1) * (u * u).mean(axis=1) - (t * u).mean(axis=1)) >= 0, 1.0, -1.0)


def extended_infomax(x: np.ndarray, rate: float = 0.3, max_steps: int = 1000, stop: float = 1e-7, anneal: float = 0.8) -> np.ndarray:
    """The unmixing matrix, components x channels, of channels x samples.

    Each step moves W by rate * (I - K tanh(u) u' - u u') W over all samples, with K the signs; the rate falls whenever two
    steps in a row point over 60 degrees apart, and steps end when the squared change is under `stop`."""
    centred = x - x.mean(axis=1, keepdims=True)
    white_by = whitening(centred)
    z = white_by @ centred
    c, n = z.shape
    w, before = np.eye(c), None
    for _ in range(max_steps):
        u = w @ z
        moment = (signs_of(u)[:, None] * np.tanh(u)) @ u.T / n + u @ u.T / n
        step = rate * (np.eye(c) - moment) @ w
        if not np.isfinite(step).all() or np.abs(w + step).max(initial=0) > 1e6:
            w, before, rate = np.eye(c), None, rate / 2
            continue
        w = w + step
        size = (step * step).sum()
        if size < stop:
            break
        if before is not None and (step * before).sum() < 0.5 * np.sqrt(size * (before * before).sum()):
            rate *= anneal
        before = step
    return w @ white_by
