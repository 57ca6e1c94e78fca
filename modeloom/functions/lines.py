"""Mains hum by multitaper regression: a sinusoid is estimated in overlapping windows, tested, and taken away."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=8)
def tapers(n: int, nw: float, k: int) -> np.ndarray:
    """k x n: the discrete prolate spheroidal sequences of most energy within nw / n, from the tridiagonal matrix that they share with it."""
    i = np.arange(n)
    off = i[1:] * (n - i[1:]) / 2
    matrix = np.diag(((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * nw / n)) + np.diag(off, 1) + np.diag(off, -1)
    found = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T
    sign = np.where(np.arange(k) % 2 == 0, found.sum(axis=1), found @ (n - 1 - 2.0 * i))
    return found * np.where(sign < 0, -1, 1)[:, None]


def sinusoids(x: np.ndarray, tapered: np.ndarray, freqs: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """Of windows m x n: the complex amplitude at each frequency that explains the tapered spectra best, and its F statistic on
    2 and 2k - 2 degrees of freedom."""
    k, n = tapered.shape
    waves = np.exp(-2j * np.pi * np.outer(np.arange(n), freqs) / fs)
    spectra = np.einsum("mn,kn,nf->mkf", x, tapered, waves, optimize=True)
    gain = tapered.sum(axis=1)
    amplitude = np.einsum("mkf,k->mf", spectra, gain) / (gain @ gain)
    rest = (np.abs(spectra - amplitude[:, None] * gain[None, :, None]) ** 2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (k - 1) * np.abs(amplitude) ** 2 * (gain @ gain) / rest
    return amplitude, np.nan_to_num(f, nan=0.0, posinf=np.inf)


def critical(p: float, k: int) -> float:
    """What an F statistic on 2 and 2k - 2 degrees of freedom exceeds with probability p."""
    return (k - 1) * (p ** (-1 / (k - 1)) - 1)


def line_of(x: np.ndarray, fs: float, freq: float, bandwidth: float, p: float, pad: int) -> np.ndarray:
    """The hum in windows m x n: at the frequency near `freq` with the greatest F, where that is significant; else zeros."""
    n = x.shape[1]
    nw = n / fs * bandwidth / 2
    k = max(2, min(n, int(2 * nw) - 1))
    grid = fs / (1 << math.ceil(math.log2(n)) + pad)
    near = freq + grid * np.arange(-math.floor(bandwidth / 2 / grid), math.floor(bandwidth / 2 / grid) + 1)
    near = near[(near > 0) & (near < fs / 2)]
    amplitude, f = sinusoids(x, tapers(n, max(nw, 1.0), k), near, fs)
    best, rows = f.argmax(axis=1), np.arange(len(x))
    wave = 2 * (amplitude[rows, best][:, None] * np.exp(2j * np.pi * np.outer(near[best], np.arange(n)) / fs)).real
    return np.where((f[rows, best] > critical(p, k))[:, None], wave, 0.0)


def without_line(x: np.ndarray, fs: float, freq: float = 50.0, window: float = 4.0, step: float = 1.0, bandwidth: float = 2.0, p: float = 0.01, pad: int = 2, tau: float = 100.0) -> np.ndarray:
    """channels x samples less the hum. Windows of `window` seconds begin every `step`; the last one ends with the signal. Where
    a window overlaps the ones before, its hum is faded in by a logistic curve of steepness tau."""
    x = np.atleast_2d(x)
    n = x.shape[1]
    size, hop = min(n, round(window * fs)), max(1, round(step * fs))
    if freq >= fs / 2 or size < 8:
        return x
    starts = sorted({*range(0, n - size + 1, hop), n - size})
    hum = np.zeros_like(x, float)
    end = 0
    for low in starts:
        own = line_of(x[:, low : low + size], fs, freq, bandwidth, p, pad)
        overlap = end - low
        if overlap > 0:
            fade = 1 / (1 + np.exp(np.clip(-tau * (np.arange(1, overlap + 1) - overlap / 2) / overlap, -700, 700)))
            own[:, :overlap] = fade * own[:, :overlap] + (1 - fade) * hum[:, low:end]
        hum[:, low : low + size] = own
        end = low + size
    return x - hum
