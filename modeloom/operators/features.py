"""The nine features of each window: as grouped aggregates, and as an Arrow function for long windows.

Both give the same numbers. The aggregates keep small windows in the JVM; the pair sum takes size**2 / 2 steps, which
numpy does for many windows at once, so from some dozens of samples on the Arrow form is faster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modeloom.functions.features import NAMES, nine


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _kernel(d: Column, sigma: Column) -> Column:
    z = d / sigma
    return F.exp(F.lit(-0.5) * z * z)


def pair_sum(x: Column, sigma: Column) -> Column:
    """Of a Gaussian kernel over all pairs of an array's values."""
    def row(a: Column, i: Column) -> Column:
        return F.aggregate(F.slice(x, i + 2, F.size(x)), F.lit(0.0), lambda s, b: s + _kernel(a - b, sigma))

    upper = F.aggregate(F.transform(x, row), F.lit(0.0), lambda s, v: s + v)
    return (F.size(x) + 2 * upper) / (F.lit(float(np.sqrt(2 * np.pi))) * sigma)


def grouped(windows: DataFrame, keys: list[str], fs: float, size: int, pairs: bool = True) -> DataFrame:
    """(keys, std, var, rms, iqr, assr, ap, mfl, ip, pcc) of (keys, i, x) with i from 0 to size - 1."""
    x, i = F.col("x"), F.col("i")
    taper = 0.54 - 0.46 * F.cos(2 * np.pi * i / (size - 1)) if size > 1 else F.lit(1.0)
    simple = windows.groupBy(*keys).agg(
        F.stddev_pop(x).alias("std"), F.var_pop(x).alias("var"), F.sqrt(F.avg(x * x)).alias("rms"),
        (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))).alias("iqr"), F.abs(F.sum(F.sqrt(F.abs(x)))).alias("assr"),
        (F.var_pop(x * taper) * size / (fs * (size // 2 + 1))).alias("ap"), F.sort_array(F.collect_list(F.struct("i", "x"))).alias("rows"),
    )
    arrays = simple.withColumn("values", F.transform("rows", lambda r: r["x"])).drop("rows")
    values = F.col("values")
    steps = lambda v: F.transform(F.slice(v, 2, F.size(v)), lambda b, k: b - F.get(v, k))
    squares = F.aggregate(_let(values, steps), F.lit(0.0), lambda s, d: s + d * d)
    flat = (F.col("std") < 1e-10) | (F.col("sigma") < 1e-10)
    out = arrays.withColumn("squares", squares).withColumn("sigma", F.col("std") * 1.06 * F.pow(F.size("values").cast("double"), F.lit(-0.2)))
    out = out.withColumn("mfl", F.when(F.col("squares") > 0, F.log10(F.sqrt("squares"))).otherwise(0.0))
    if not pairs:
        return out.select(*keys, "std", "var", "rms", "iqr", "assr", "ap", "mfl")
    n, peak = F.size("values"), 1 / (F.lit(float(np.sqrt(2 * np.pi))) * F.col("sigma"))
    out = out.withColumn("pair_sum", F.when(~flat, _let(values, lambda v: pair_sum(v, F.col("sigma")))))
    lagged = F.aggregate(_let(values, steps), F.lit(0.0), lambda s, d: s + _kernel(d, F.col("sigma"))) * peak / (n - 1)
    return out.select(
        *keys, "std", "var", "rms", "iqr", "assr", "ap", "mfl", F.when(flat, 0.0).otherwise(F.col("pair_sum") / (n * n)).alias("ip"),
        F.when(flat | (n < 2), 0.0).otherwise(lagged - (F.col("pair_sum") - n * peak) / (2 * n * n)).alias("pcc"), "sigma", F.coalesce("pair_sum", F.lit(0.0)).alias("pair_sum"),
    )


def fast(windows: DataFrame, keys: list[str], fs: float, values: str = "values") -> DataFrame:
    """The same of arrays of values, in Arrow batches; rows with arrays of one length are worked on together."""
    own = windows.select(*keys, values)
    schema = T.StructType([*own.select(*keys).schema.fields, *(T.StructField(n.lower(), T.DoubleType()) for n in NAMES)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.zeros((len(frame), len(NAMES)))
            lengths = frame[values].map(lambda v: 0 if v is None else len(v)).to_numpy()
            for n in np.unique(lengths[lengths > 0]):
                at = np.flatnonzero(lengths == n)
                for a in range(0, len(at), 256):
                    out[at[a : a + 256]] = nine(np.stack(frame[values].iloc[at[a : a + 256]].to_numpy()).astype(float), fs)
            yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(out, columns=[n.lower() for n in NAMES])], axis=1)

    return own.mapInPandas(run, schema)


def summary(modes: DataFrame, count: str = "n_modes") -> DataFrame:
    return modes.agg(F.count("*").alias("n_segments"), F.min(count).alias("min_modes"), F.max(count).alias("max_modes"), F.avg(count).alias("mean_modes"))
