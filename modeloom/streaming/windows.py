"""Windows over unbounded samples.

Each subject's state is the samples that windows to come still need, fewer than a window has. A window is given out when
a sample beyond its end has come, which is the rule for recordings too: one that would end with the last sample isn't.
Samples of one subject are taken in the order of their time within a batch; late ones, from before what was given out,
are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modeloom.functions.features import NAMES, nine

OUT = "subject long, w long, " + ", ".join(f"{n.lower()} double" for n in NAMES)


def _advance(size: int, step: int, fs: float):
    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, done, last = (list(x) if i == 0 else x for i, x in enumerate(state.get)) if state.exists else ([], 0, -np.inf)
        new = pd.concat(list(frames)).sort_values("at")
        new = new[new["at"] > last]
        if len(new):
            last = float(new["at"].iloc[-1])
        values = np.array([*kept, *new["x"].tolist()])
        count = max(0, (len(values) - size - 1) // step + 1) if len(values) > size else 0
        if count:
            rows = np.stack([values[i * step : i * step + size] for i in range(count)])
            out = pd.DataFrame(nine(rows, fs), columns=[n.lower() for n in NAMES])
            out.insert(0, "w", np.arange(done, done + count))
            out.insert(0, "subject", key[0])
            yield out
        state.update((values[count * step :].tolist(), done + count, float(last)))

    return advance


def window_features(samples: DataFrame, size: int, step: int, fs: float) -> DataFrame:
    """A stream of (subject, w, the nine features) from a stream of (subject, at, x)."""
    grouped = samples.select(F.col("subject").cast("long"), F.col("at").cast("double"), F.col("x").cast("double")).groupBy("subject")
    return grouped.applyInPandasWithState(_advance(size, step, fs), OUT, "kept array<double>, done long, last double", "append", GroupStateTimeout.NoTimeout)


def windowed_summary(samples: DataFrame, at: str = "ts", late: str = "10 minutes", length: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts, means and deviations over windows of time, with a bound on lateness."""
    stamped = samples.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return stamped.groupBy("subject", F.window("__at", length, slide)).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")).select("subject", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "std")
