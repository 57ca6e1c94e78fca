"""Filters over whole recordings, as Arrow functions on channels x samples; and what of them SQL can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.functions import filters, ica, wavelets


#: Samples of recordings of one length and rate that one call of a kernel for single channels gets.
TOGETHER = 1 << 22


def mapped(recordings: DataFrame, kernel: Callable[[np.ndarray, float], np.ndarray], signal: str = "signal", fs: float | str = 128.0, each_channel: bool = False, stacked: bool = False) -> DataFrame:
    """The recordings with kernel(signal, fs) for their signal; what isn't finite becomes 0.

    A kernel that works on each channel by itself gets the channels of many recordings of one length and rate at once; a
    `stacked` one gets recordings of one shape and rate as recordings x channels x samples."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rates = frame[fs] if isinstance(fs, str) else [fs] * len(frame)
            inputs = [np.stack([np.asarray(c, float) for c in x]) if x is not None and len(x) else np.zeros((0, 0)) for x in frame[signal]]
            out, groups = [x.tolist() for x in inputs], {}
            for k, (x, rate) in enumerate(zip(inputs, rates, strict=True)):
                if x.size:
                    groups.setdefault((x.shape[1], float(rate)) if each_channel else (*x.shape, float(rate)) if stacked else k, []).append((k, float(rate)))
            for rows in groups.values():
                few = max(1, TOGETHER // max(inputs[k].size for k, _ in rows))
                for low in range(0, len(rows), few):
                    some = [k for k, _ in rows[low : low + few]]
                    y = kernel(np.stack([inputs[k] for k in some]) if stacked else np.concatenate([inputs[k] for k in some]), rows[0][1])
                    y = y.reshape(-1, y.shape[-1])
                    y = np.where(np.isfinite(y), y, 0.0)
                    ends = np.cumsum([len(inputs[k]) for k in some])
                    for k, part in zip(some, np.split(y, ends[:-1]), strict=True):
                        out[k] = part.tolist()
            yield frame.assign(**{signal: out})

    return recordings.mapInPandas(run, recordings.schema)


def bandpass(recordings: DataFrame, low: float, high: float, order: int = 4, **kw) -> DataFrame:
    return mapped(recordings, lambda x, fs: filters.bandpass(x, fs, low, high, order), each_channel=True, **kw)


def notch(recordings: DataFrame, freq: float = 50.0, q: float = 30.0, **kw) -> DataFrame:
    return mapped(recordings, lambda x, fs: filters.stop_band(x, fs, freq, q), each_channel=True, **kw)


def denoise(recordings: DataFrame, level: int = 6, **kw) -> DataFrame:
    return mapped(recordings, lambda x, fs: wavelets.denoise(x, level), each_channel=True, **kw)


def remove_artifacts(recordings: DataFrame, remove: int = 2, seed: int = 42, **kw) -> DataFrame:
    return mapped(recordings, lambda x, fs: ica.without_artifacts_of_many(x, remove, seed), stacked=True, **kw)


def clean_raw(recordings: DataFrame, low: float = 0.5, high: float = 60.0, line: float = 50.0, method: str = "SURE", **kw) -> DataFrame:
    """Band-pass, notch, and wavelet denoising twice, in one pass over each recording."""
    if method != "SURE":
        raise ValueError(f"denoising by {method!r} isn't there")

    def chain(x: np.ndarray, fs: float) -> np.ndarray:
        y = filters.stop_band(filters.bandpass(x, fs, low, high), fs, line)
        return wavelets.denoise(wavelets.denoise(y))

    return mapped(recordings, chain, each_channel=True, **kw)


def clean_approximately(recordings: DataFrame, remove: int = 2, **kw) -> DataFrame:
    """Band-pass 1 to 30 Hz, notches at 50 and 60 Hz, components of great kurtosis taken out."""

    def chain(x: np.ndarray, fs: float) -> np.ndarray:
        y = filters.bandpass(x.reshape(-1, x.shape[2]), fs, 1.0, 30.0)
        for line in (50.0, 60.0):
            y = filters.stop_band(y, fs, line)
        return ica.without_artifacts_of_many(y.reshape(x.shape), remove)

    return mapped(recordings, chain, stacked=True, **kw)


def preprocess(recordings: DataFrame, mode: str = "B", **kw) -> DataFrame:
    """Mode B takes recordings as they are, mode A cleans them."""
    if mode.upper() not in ("A", "B"):
        raise ValueError(f"mode {mode!r} is neither A nor B")
    return recordings if mode.upper() == "B" else clean_approximately(recordings, **kw)


def envelope(recordings: DataFrame, **kw) -> DataFrame:
    return mapped(recordings, lambda x, fs: np.abs(filters.analytic(x)), each_channel=True, **kw)


def sure_thresholds(coefficients: DataFrame, keys: list[str], value: str = "c") -> DataFrame:
    """(keys, threshold) by running sums over sorted magnitudes."""
    sigma = coefficients.groupBy(*keys).agg((F.median(F.abs(value)) / 0.6745).alias("sigma"), F.count("*").alias("n"))
    scaled = coefficients.join(sigma, keys).select(*keys, "sigma", "n", (F.abs(value) / F.when(F.col("sigma") >= 1e-10, F.col("sigma"))).alias("a"))
    upto = Window.partitionBy(*keys).orderBy("a").rangeBetween(Window.unboundedPreceding, 0)
    risk = F.col("n") - 2 * F.col("upto") + F.col("squares") + (F.col("n") - F.col("upto")) * F.col("a") * F.col("a")
    ranked = scaled.withColumn("upto", F.count("*").over(upto)).withColumn("squares", F.sum(F.col("a") * F.col("a")).over(upto)).withColumn("risk", F.round(risk, 9))
    best = ranked.groupBy(*keys, "sigma").agg(F.min_by("a", F.struct("risk", "a")).alias("a"))
    return best.select(*keys, F.when(F.col("sigma") < 1e-10, 0.0).otherwise(F.col("a") * F.col("sigma")).alias("threshold"))


def spectrum(samples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, k, re, im) of samples (keys, t, x) of one length: the sums of a discrete Fourier transform, for short windows."""
    angle = -2 * np.pi * F.pmod(F.col("k") * F.col("t"), F.lit(size)) / size
    spread = samples.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(size // 2))))
    return spread.groupBy(*keys, "k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
