"""Zero-phase IIR filters by second-order sections."""

from __future__ import annotations

import numpy as np


def butterworth_bandpass(low: float, high: float, fs: float, order: int = 4) -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) of a Butterworth band-pass of 2 * order poles."""
    nyquist = fs / 2
    if low >= nyquist or high >= nyquist:
        low, high = max(low, 0.1), min(high, nyquist - 0.5)
    warp = 4 * np.tan(np.pi * np.array([low, high]) / fs)
    width, centre2 = warp[1] - warp[0], warp[0] * warp[1]
    k = np.arange(1, order + 1)
    prototype = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre2 + 0j)
    analog = np.concatenate([half + root, half - root])
    poles = (4 + analog) / (4 - analog)
    upper = sorted(poles[poles.imag > 0], key=lambda p: abs(p), reverse=False)
    sections = np.array([[1.0, 0.0, -1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    # Unit gain at the centre of the band.
    z = np.exp(2j * np.arctan(np.sqrt(centre2) / 4))
    gain = np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[4] / z + s[5] / z**2) for s in sections])
    sections[0, :3] /= abs(gain)
    return sections


def notch(freq: float, fs: float, q: float = 30.0) -> np.ndarray:
    """One section that stops `freq`."""
    w = 2 * np.pi * freq / fs
    g = 1 / (1 + np.tan(w / q / 2))
    return np.array([[g, -2 * g * np.cos(w), g, 1.0, -2 * g * np.cos(w), 2 * g - 1]])


def _run(sections: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed over the last axis; state: sections x 2 x channels."""
    y = x.T.copy()
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        z0, z1 = state[s]
        for t in range(len(y)):
            v = y[t]
            out = b0 * v + z0
            z0, z1 = b1 * v - a1 * out + z1, b2 * v - a2 * out
            y[t] = out
    return y.T


def steady_state(sections: np.ndarray) -> np.ndarray:
    """State of each section for a constant input of 1 to the first."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        after = level * (b0 + b1 + b2) / (1 + a1 + a2)
        out.append([after - b0 * level, b2 * level - a2 * after])
        level = after
    return np.array(out)


def forward_backward(sections: np.ndarray, x: np.ndarray, pad: int) -> np.ndarray:
    """Filters channels x samples forth and back with odd padding."""
    x = np.atleast_2d(x)
    pad = min(pad, x.shape[1] - 1)
    if pad > 0:
        x = np.concatenate([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]], axis=1)
    steady = steady_state(sections)
    for _ in range(2):
        x = _run(sections, x, steady[:, :, None] * x[:, 0])[:, ::-1]
    return x[:, pad : x.shape[1] - pad] if pad > 0 else x


def bandpass(x: np.ndarray, fs: float, low: float, high: float, order: int = 4) -> np.ndarray:
    sections = butterworth_bandpass(low, high, fs, order)
    return forward_backward(sections, x, 3 * (2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())))


def stop_band(x: np.ndarray, fs: float, freq: float = 50.0, q: float = 30.0) -> np.ndarray:
    return np.atleast_2d(x) if freq >= fs / 2 else forward_backward(notch(freq, fs, q), x, 9)


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal with its Hilbert transform as the imaginary part."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)
