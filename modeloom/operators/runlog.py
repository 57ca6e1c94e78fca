"""What a run did: rows and seconds of its stages, told by the jobs that do the work themselves.

Rows are counted by an `Observation` on the plan of a stage, so no second job counts them. A stage that is kept is written
and read again; its seconds are those of the write. A stage that is only watched is counted whenever a later one runs, and
has no seconds of its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from modeloom.sources import results
from modeloom.sources.shared import written

LOGGED = "run string, position int, stage string, rows long, seconds double, more map<string,double>"


@dataclass
class Stage:
    name: str
    seen: Observation
    seconds: float | None = None


@dataclass
class RunLog:
    run: str
    stages: list[Stage] = field(default_factory=list)

    def watch(self, name: str, frame: DataFrame, **more: Column) -> DataFrame:
        """The frame, whose rows are counted when a job runs it; `more` are further aggregates over it, by name."""
        stage = Stage(name, Observation())
        self.stages.append(stage)
        return frame.observe(stage.seen, F.count(F.lit(1)).alias("rows"), *[c.cast("double").alias(k) for k, c in more.items()])

    def keep(self, name: str, make: DataFrame | Callable[[], DataFrame], **more: Column) -> DataFrame:
        """The same, written at once; of a function the jobs that it runs to make the frame count as well."""
        began = time.perf_counter()
        out = written(self.watch(name, make() if callable(make) else make, **more))
        self.stages[-1].seconds = time.perf_counter() - began
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """What is known of the stages whose jobs have run."""
        found = []
        for i, s in enumerate(self.stages):
            got = dict(s.seen.get)
            rows = got.pop("rows")
            found.append((self.run, i, s.name, rows, s.seconds, {k: v for k, v in got.items() if v is not None}))
        return spark.createDataFrame(found, LOGGED)

    def write(self, spark: SparkSession, folder: str) -> None:
        results.write_bundle(self.rows(spark), folder)
