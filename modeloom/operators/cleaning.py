"""Recordings cleaned by their components: band-pass, mains hum, unmixing, features of the components, removal of the worst.

A recording is one row. The filters and the unmixing are one Arrow pass over recordings, which leaves each component's
scalp weights and the moments of its epochs; features, thresholds and the choice of components are joins and grouped
aggregates over those small tables, and a second pass takes the chosen components out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from modeloom.functions import fir, infomax, lines
from modeloom.functions.ica import two_gaussians
from modeloom.operators import artifacts, signals


def fir_bandpass(recordings: DataFrame, low: float, high: float, **kw) -> DataFrame:
    return signals.mapped(recordings, lambda x, fs: fir.bandpass(x, fs, low, high), each_channel=True, **kw)


def remove_line(recordings: DataFrame, freq: float = 50.0, **kw) -> DataFrame:
    """`window`, `step`, `bandwidth`, `p`, `pad` and `tau` are those of `lines.without_line`."""
    own = {k: kw.pop(k) for k in ("window", "step", "bandwidth", "p", "pad", "tau") if k in kw}
    return signals.mapped(recordings, lambda x, fs: lines.without_line(x, fs, freq, **own), each_channel=True, **kw)


def filtered(recordings: DataFrame, low: float, high: float, line: float | None, **kw) -> DataFrame:
    """Band-pass, and the hum at `line` taken out where the band holds it; one pass."""

    def chain(x: np.ndarray, fs: float) -> np.ndarray:
        y = fir.bandpass(x, fs, low, high)
        return lines.without_line(y, fs, line) if line is not None and high > line else y

    return signals.mapped(recordings, chain, each_channel=True, **kw)


def _matrix(x) -> np.ndarray:
    return np.stack([np.asarray(c, float) for c in x]) if x is not None and len(x) else np.zeros((0, 0))


def epoch_moments(x: np.ndarray, size: int | None) -> list[list[tuple[float, float]]]:
    """Of each row the excess kurtosis and the variance of its epochs; a rest shorter than an epoch is left out, all is one where there is no size."""
    size = min(size or x.shape[1], x.shape[1])
    e = x[:, : x.shape[1] // size * size].reshape(len(x), -1, size)
    d = e - e.mean(axis=2, keepdims=True)
    var = (d * d).mean(axis=2)
    kurt = np.divide((d**4).mean(axis=2), var * var, out=np.full_like(var, 3.0), where=var > 0) - 3
    return [[(float(k), float(v) * size / max(size - 1, 1)) for k, v in zip(a, b, strict=True)] for a, b in zip(kurt, var, strict=True)]


def unmixed(recordings: DataFrame, signal: str = "signal", epoch: int | None = None) -> DataFrame:
    """The recordings with `unmix` (components x channels), `scalp` (the components' weights on the channels, of length 1) and
    `moments` (kurtosis and variance of each component's epochs, at the scale of the weights)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"unmix": [], "scalp": [], "moments": []}
            for x in map(_matrix, frame[signal]):
                w = infomax.extended_infomax(x) if x.size else np.zeros((0, 0))
                back = np.linalg.pinv(w).T if x.size else w
                length = np.linalg.norm(back, axis=1, keepdims=True)
                out["unmix"].append(w.tolist())
                out["scalp"].append((back / np.where(length > 0, length, 1)).tolist())
                u = w @ (x - x.mean(axis=1, keepdims=True)) * length if x.size else w
                out["moments"].append([[{"k": k, "v": v} for k, v in row] for row in epoch_moments(u, epoch)] if x.size else [])
            yield frame.assign(**out)

    square = T.ArrayType(T.ArrayType(T.DoubleType()))
    moment = T.ArrayType(T.ArrayType(T.StructType([T.StructField("k", T.DoubleType()), T.StructField("v", T.DoubleType())])))
    return recordings.mapInPandas(run, T.StructType([*recordings.schema.fields, T.StructField("unmix", square), T.StructField("scalp", square), T.StructField("moments", moment)]))


def component_features(parts: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """(key, ic, features) of `unmixed` recordings whose channels are the numbered places in order."""
    weights = parts.select(key, F.posexplode("scalp").alias("ic", "row")).select(key, "ic", F.posexplode("row").alias("p", "w")).select(key, "ic", (F.col("p") + 1).alias("number"), "w")
    each = parts.select(key, F.posexplode("moments").alias("ic", "row")).select(key, "ic", F.posexplode("row").alias("epoch", "m")).select(key, "ic", "epoch", "m.k", "m.v")
    return artifacts.spatial(weights, places, [key, "ic"]).join(artifacts.over_epochs(each, [key, "ic"]), [key, "ic"])


def limits_each(features: DataFrame, key: str) -> DataFrame:
    """(key, limit of each feature): the borders of low and high components of one recording, which has as many as channels."""

    def one(own: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [own[0]], **{f"{f}_limit": [two_gaussians(frame[f].to_numpy())] for f in artifacts.FEATURES}})

    kind = features.schema[key].dataType.simpleString()
    return features.select(key, *artifacts.FEATURES).groupBy(key).applyInPandas(one, f"{key} {kind}, " + ", ".join(f"{f}_limit double" for f in artifacts.FEATURES))


def worst_components(features: DataFrame, limits: DataFrame, key: str, remove: int = 2) -> DataFrame:
    """(key, removed): the worst components of each recording that are bad at all; of equally bad ones the last."""
    excess = lambda f: F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col(f) - F.col(f"{f}_limit"), F.col(f"{f}_limit")), F.lit(0.0)))
    scored = features.join(limits, key).withColumn("badness", sum((excess(f) for f in artifacts.FEATURES), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("badness"), F.desc("ic")))
    return scored.filter("badness > 0").withColumn("r", rank).filter(F.col("r") <= remove).groupBy(key).agg(F.sort_array(F.collect_list("ic")).alias("removed"))


def without_components(parts: DataFrame, removed: DataFrame, key: str, signal: str = "signal") -> DataFrame:
    """`parts` with their signal less the removed components, and `removed`."""
    joined = parts.drop("scalp", "moments").join(removed, key, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for x, w, gone in zip(map(_matrix, frame[signal]), map(_matrix, frame["unmix"]), frame["removed"], strict=True):
                gone = np.asarray(gone, int)
                out.append((x - np.linalg.pinv(w)[:, gone] @ (w[gone] @ x)).tolist() if len(gone) else x.tolist())
            yield frame.assign(**{signal: out}).drop(columns="unmix")

    kept = joined.drop("unmix")
    return joined.mapInPandas(run, kept.schema)


def clean_by_components(recordings: DataFrame, places: DataFrame, key: str, low: float = 1.0, high: float | None = None, line: float | None = 50.0, remove: int = 2, epoch: int | None = None, fs: float = 128.0, keep=None) -> DataFrame:
    """The whole chain; `keep` writes or caches a table that is read twice (the unmixed recordings)."""
    parts = unmixed(filtered(recordings, low, 0.4 * fs if high is None else high, line, fs=fs), epoch=epoch)
    parts = keep(parts) if keep else parts
    found = component_features(parts, places, key)
    return without_components(parts, worst_components(found, limits_each(found, key), key, remove), key)
