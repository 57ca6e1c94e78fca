"""Successive multichannel decomposition into modes around common centre frequencies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Settings:
    alpha: float = 2000.0
    tau: float = 0.0
    tol: float = 1e-10
    max_iter: int = 500
    max_modes: int = 20
    stop: float = 0.01
    init: str = "uniform"
    seed: int = 42


@dataclass
class Modes:
    modes: np.ndarray  # modes x channels x samples
    freqs: np.ndarray  # in Hz
    energies: np.ndarray  # modes x channels
    iterations: np.ndarray
    error: float
    residual: np.ndarray


def _start(k: int, s: Settings, rng: np.random.RandomState) -> float:
    first = (k + 1) / (s.max_modes + 1) * 0.5 if s.init == "uniform" else rng.uniform(0, 0.5) if s.init == "random" else 0.25
    return float(np.clip(first, 1e-6, 0.5 - 1e-6))


def one_mode(residual: np.ndarray, k: int, s: Settings, rng: np.random.RandomState) -> tuple[np.ndarray, float, int]:
    """The mode, its normalised frequency, the iterations. Without a dual step the filtered spectrum is a function of the
    frequency alone, so only the power over channels is iterated and the spectrum is built once."""
    n = residual.shape[1]
    spectrum = np.fft.fft(residual, axis=1)[:, : n // 2 + 1]
    axis = np.fft.fftfreq(n)[: n // 2 + 1]  # the last one of an even length is -0.5, and is used as such
    freq, power = _start(k, s, rng), (np.abs(spectrum) ** 2).sum(axis=0)
    dual = np.zeros_like(spectrum)
    for i in range(1, s.max_iter + 1):
        gain = 1 / (1 + 2 * s.alpha * (axis - freq) ** 2)
        used = freq
        if s.tau > 0:
            filtered = (spectrum + dual / 2) * gain
            weight = (np.abs(filtered) ** 2).sum(axis=0)
            dual += s.tau * (spectrum - filtered)
        else:
            weight = power * gain**2
        new = float(np.clip((axis * weight).sum() / (weight.sum() + 1e-12), 1e-6, 0.5 - 1e-6))
        moved, freq = abs(new - freq), new
        if moved < s.tol:
            break
    mode = filtered if s.tau > 0 else spectrum / (1 + 2 * s.alpha * (axis - used) ** 2)
    full = np.zeros((residual.shape[0], n), complex)
    full[:, : n // 2 + 1] = mode
    mirrored = np.arange(1, (n + 1) // 2)
    full[:, n - mirrored] = np.conj(mode[:, mirrored])
    return np.fft.ifft(full, axis=1).real, freq, i


def decompose(x: np.ndarray, fs: float, s: Settings = Settings()) -> Modes:
    """Peels modes from the residual until little energy is left."""
    x = np.nan_to_num(np.asarray(x, float))
    total, residual, rng = (x**2).sum(), x.copy(), np.random.RandomState(s.seed)
    modes, freqs, iterations = [], [], []
    for k in range(s.max_modes):
        if (residual**2).sum() / (total + 1e-10) < s.stop:
            break
        mode, freq, i = one_mode(residual, k, s, rng)
        if (mode**2).sum() < 1e-12:
            break
        modes.append(mode)
        freqs.append(freq * fs)
        iterations.append(i)
        residual = residual - mode
    found = np.array(modes).reshape(len(modes), *x.shape)
    error = float((residual**2).sum() / (total + 1e-10))
    return Modes(found, np.array(freqs), (found**2).sum(axis=2), np.array(iterations, int), error, residual)
