"""Sliding windows over recordings.

A window is `size` samples, the next begins `step` later. A window that would end with the recording's last sample is
left out unless it is the only one; with `partial`, the rest is filled up with zeros instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def size_and_step(seconds: float, fs: float, overlap: float) -> tuple[int, int]:
    if not 0 < overlap < 1:
        raise ValueError("the overlap lies between 0 and 1, both excluded")
    size = int(seconds * fs)
    return size, max(1, int(size * (1 - overlap)))


def count_of(length: Column, size: int, step: int, partial: bool = False) -> Column:
    """How many windows a recording of so many samples has."""
    if partial:
        return F.when(length <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil((length - size) / step) + 1)).cast("int")
    return F.when(length < size, 0).otherwise(F.greatest(F.lit(1), F.floor((length - size - 1) / step) + 1)).cast("int")


def long_windows(samples: DataFrame, size: int, step: int, keys: list[str]) -> DataFrame:
    """(keys, w, i, x) of samples (keys, t, x): each sample goes straight to the windows that hold it."""
    length = F.count("*").over(Window.partitionBy(*keys))
    counted = samples.select(*keys, "t", "x", length.alias("length")).filter(F.col("length") >= size)
    first = F.greatest(F.lit(0), F.floor((F.col("t") - size) / step) + 1)
    last = F.least(count_of(F.col("length"), size, step) - 1, F.floor(F.col("t") / step))
    placed = counted.filter(first <= last).select(*keys, "t", "x", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("w"))
    return placed.select(*keys, "w", (F.col("t") - F.col("w") * step).cast("int").alias("i"), "x")


def array_windows(recordings: DataFrame, size: int, step: int, signal: str = "signal", partial: bool = False) -> DataFrame:
    """One row a window, with segment_index and the signal (channels x samples) cut to it."""
    n = count_of(F.size(F.get(signal, F.lit(0))), size, step, partial)
    rows = recordings.filter(n > 0).withColumn("segment_index", F.explode(F.sequence(F.lit(0), n - 1)))

    def cut(channel: Column) -> Column:
        part = F.slice(channel, F.col("segment_index") * step + 1, size)
        return F.concat(part, F.array_repeat(F.lit(0.0), size - F.size(part))) if partial else part

    return rows.withColumn(signal, F.transform(signal, cut))


def metadata(windows: DataFrame, size: int, step: int, fs: float, n_channels: int, index: str = "segment_index") -> DataFrame:
    """Adds where each window begins and ends, in samples and seconds."""
    start = F.col(index) * step
    return windows.withColumns({
        "start_sample": start, "end_sample": start + size, "start_time_sec": start / fs, "end_time_sec": (start + size) / fs,
        "n_channels": F.lit(n_channels), "window_samples": F.lit(size), "fs": F.lit(float(fs)),
    })


def verify_counts(segments: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by keys beside what is expected of them."""
    found = segments.groupBy(*keys).agg(F.count("*").alias("found"))
    joined = expected.join(found, keys, "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.withColumn("matches", F.col("found") == F.col("expected"))


def integrity(windows: DataFrame, size: int, values: str = "values", label: str = "label", subject: str = "subject") -> DataFrame:
    """One row of counts of what is wrong."""
    broken = lambda test: F.count_if(F.exists(values, test))
    return windows.agg(
        F.count("*").alias("n"), F.count_if(F.size(values) != size).alias("bad_shape"), broken(F.isnan).alias("with_nan"),
        broken(lambda x: F.abs(x) == float("inf")).alias("with_inf"), F.count_if(F.col(subject).isNull()).alias("no_subject"), F.count_if(~F.col(label).isin(0, 1)).alias("bad_label"),
    )


def positions(segments: DataFrame, subject: str, order: list[str], period: int) -> DataFrame:
    """Adds `pos`, the place of a window in its recording; a subject's recordings of `period` windows follow each other."""
    return segments.withColumn("pos", F.pmod(F.row_number().over(Window.partitionBy(subject).orderBy(*order)) - 1, F.lit(period)))


def without_overlap(segments: DataFrame, pos: str = "pos") -> DataFrame:
    """Every second window of each recording: those that don't overlap at a step of half a window."""
    return segments.filter(F.col(pos) % 2 == 0)
