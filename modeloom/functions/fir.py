"""Band-pass by a windowed sinc, run over whole recordings by overlap-add."""

from __future__ import annotations

import math

import numpy as np


def transition(low: float, high: float, fs: float) -> float:
    """Width of the band edges: a quarter of the lower edge, 2 Hz at least, but no more than there is room for."""
    return min(max(low / 4, 2.0), low, fs / 2 - high)


def order_of(width: float, fs: float) -> int:
    """The even order that a Hamming window needs for edges of that width."""
    return 2 * math.ceil(3.3 * fs / width / 2)


def low_pass(cut: float, fs: float, order: int) -> np.ndarray:
    """order + 1 taps of unit gain at 0, half of it at `cut`."""
    at = np.arange(order + 1) - order / 2
    taps = np.sinc(2 * cut / fs * at) * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(order + 1) / order))
    return taps / taps.sum()


def band_taps(low: float, high: float, fs: float) -> np.ndarray:
    """Passes low to high in full; the edges lie outside."""
    if not 0 < low < high < fs / 2:
        raise ValueError(f"0 < {low} < {high} < {fs / 2} doesn't hold")
    width = transition(low, high, fs)
    order = order_of(width, fs)
    return low_pass(high + width / 2, fs, order) - low_pass(low - width / 2, fs, order)


def overlap_add(taps: np.ndarray, x: np.ndarray) -> np.ndarray:
    """channels x samples by symmetric taps, without delay; beyond its ends a signal stays as it is there.

    Blocks of all channels are transformed at once; what a block's result has beyond the block is added to the next."""
    tail = len(taps) - 1
    half, n = tail // 2, x.shape[1]
    size = 1 << max(10, math.ceil(math.log2(4 * len(taps))))
    step = size - tail
    padded = np.concatenate([np.repeat(x[:, :1], half, axis=1), x, np.repeat(x[:, -1:], half, axis=1)], axis=1)
    blocks = -(-padded.shape[1] // step)
    padded = np.pad(padded, ((0, 0), (0, blocks * step - padded.shape[1]))).reshape(len(x), blocks, step)
    done = np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(taps, size), size)
    out = done[:, :, :step]
    out[:, 1:, :tail] += done[:, :-1, step:]
    return out.reshape(len(x), -1)[:, tail : tail + n]


def bandpass(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    return overlap_add(band_taps(low, high, fs), np.atleast_2d(x))
