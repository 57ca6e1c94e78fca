"""From features of modes to one vector a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mode_energy(samples: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Sum of squares by keys."""
    return samples.groupBy(*keys).agg(F.sum(F.col(value) * F.col(value)).alias("energy"))


def weighted(features: DataFrame, keys: list[str], names: list[str], energy: str = "energy") -> DataFrame:
    """Means over modes weighted by their energy."""
    return features.groupBy(*keys).agg(*[(F.sum(F.col(n) * F.col(energy)) / (F.sum(energy) + 1e-12)).alias(n) for n in names])


def vectors(channels: DataFrame, keys: list[str], names: list[str], channel: str = "channel") -> DataFrame:
    """(keys, f): features of all channels as an array, channel by channel."""
    each = channels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(channel).alias("c"), F.array(*names).alias("v")))).alias("rows"))
    return each.select(*keys, F.flatten(F.transform("rows", lambda r: r["v"])).alias("f"))


def complete(segments: DataFrame, found: DataFrame, keys: list[str], size: int, column: str = "f") -> DataFrame:
    """A vector of `size` for every segment: cut or filled up with 0, and 0 for what is missing or not finite."""
    joined = segments.join(found, keys, "left")
    full = F.slice(F.concat(F.coalesce(column, F.array().cast("array<double>")), F.array_repeat(F.lit(0.0), size)), 1, size)
    finite = F.transform(full, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))
    return joined.withColumn(column, finite)


def health(matrix: DataFrame, column: str = "f") -> DataFrame:
    """One row: rows, sizes, and how many values aren't numbers or are infinite, with the range of the others."""
    values = matrix.select(F.size(column).alias("size"), F.explode(column).alias("v"))
    good = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    return values.agg(F.count("*").alias("n_values"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.count_if(F.isnan("v")).alias("n_nan"), F.count_if(F.abs("v") == float("inf")).alias("n_inf"), F.min(good).alias("low"), F.max(good).alias("high"))
