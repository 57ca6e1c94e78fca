"""Decomposition of windows into modes, alone or with features and energy weights in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modeloom.functions.features import integrate, nine
from modeloom.functions.smvmd import Settings
from modeloom.functions.smvmd import decompose as run_one

RESULT = "n_modes int, error double, freqs array<double>, iterations array<int>, energies array<array<double>>, modes array<array<array<double>>>"


def _matrix(x) -> np.ndarray:
    return np.stack([np.asarray(c, float) for c in x])


def decompose(segments: DataFrame, keys: list[str], fs: float, settings: Settings = Settings(), signal: str = "signal") -> DataFrame:
    """(keys, n_modes, error, freqs, iterations, energies, modes)."""
    own = segments.select(*keys, signal)
    fields = T._parse_datatype_string(RESULT).fields

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for x in frame[signal]:
                r = run_one(_matrix(x), fs, settings)
                rows.append((len(r.freqs), r.error, r.freqs.tolist(), r.iterations.tolist(), r.energies.tolist(), r.modes.tolist()))
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(rows, columns=[f.name for f in fields])], axis=1)

    return own.mapInPandas(run, T.StructType([*own.select(*keys).schema.fields, *fields]))


def feature_vectors(segments: DataFrame, keys: list[str], fs: float, settings: Settings = Settings(), signal: str = "signal") -> DataFrame:
    """(keys, n_modes, f, error): modes never leave the worker. A segment that fails has a null vector and says why."""
    own = segments.select(*keys, signal)
    schema = T.StructType([*own.select(*keys).schema.fields, *T._parse_datatype_string("n_modes int, f array<double>, error string").fields])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for x in frame[signal]:
                try:
                    r = run_one(_matrix(x), fs, settings)
                    k, c, n = r.modes.shape
                    per_mode = nine(r.modes.reshape(k * c, n), fs).reshape(k, c, -1)
                    rows.append((k, integrate(per_mode, r.energies).tolist(), None))
                except (ValueError, TypeError, np.linalg.LinAlgError) as e:
                    rows.append((None, None, f"{type(e).__name__}: {e}"))
            made = pd.DataFrame(rows, columns=["n_modes", "f", "error"]).astype({"n_modes": "Int32"})
            yield pd.concat([frame[keys].reset_index(drop=True), made], axis=1)

    return own.mapInPandas(run, schema)


def long_modes(decomposed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, channel, t, x)."""
    by_mode = decomposed.select(*keys, F.posexplode("modes").alias("k", "mode"))
    by_channel = by_mode.select(*keys, "k", F.posexplode("mode").alias("channel", "samples"))
    return by_channel.select(*keys, "k", "channel", F.posexplode("samples").alias("t", "x"))


def validate(segments: DataFrame, decomposed: DataFrame, keys: list[str], fs: float, signal: str = "signal") -> DataFrame:
    """(keys, error, freqs_in_range, finite, min_energy): the relative energy of what modes leave, by sums over samples."""
    whole = segments.select(*keys, F.posexplode(signal).alias("channel", "s")).select(*keys, "channel", F.posexplode("s").alias("t", "x"))
    summed = long_modes(decomposed, keys).groupBy(*keys, "channel", "t").agg(F.sum("x").alias("y"))
    left = whole.join(summed, [*keys, "channel", "t"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    errors = left.groupBy(*keys).agg((F.sum(F.pow(F.col("x") - F.col("y"), 2)) / (F.sum(F.col("x") * F.col("x")) + 1e-10)).alias("error"), F.bool_and(~F.isnan("y")).alias("finite"))
    shape = decomposed.select(*keys, F.forall("freqs", lambda f: (f >= 0) & (f <= fs / 2)).alias("freqs_in_range"), F.array_min(F.transform("energies", lambda e: F.aggregate(e, F.lit(0.0), lambda s, v: s + v))).alias("min_energy"))
    return errors.join(shape, keys)


def mode_statistics(counts: DataFrame, count: str = "n_modes", cap: int = 20) -> DataFrame:
    n = F.col(count)
    return counts.agg(F.count("*").alias("n"), F.min(n).alias("low"), F.max(n).alias("high"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.median(n).alias("median"), F.count_if(n >= cap).alias("at_cap"), (F.count_if(n >= cap) * 100.0 / F.count("*")).alias("pct_at_cap"), (F.min(n) != F.max(n)).alias("varies"))
