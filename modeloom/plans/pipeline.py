"""Whole experiments: recordings to windows, modes, features, ranking, both protocols of folds, and what is left of a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.functions.smvmd import Settings
from modeloom.operators import decompose, energy, folds, metrics, runlog, segments, selection, signals
from modeloom.plans import experiments
from modeloom.plans.experiments import Experiment
from modeloom.sources import results


@dataclass
class Outcome:
    """The tables of an experiment; all but the log's are written where they are read more than once."""

    matrix: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    fold_accuracies: DataFrame
    independent: DataFrame
    modes: DataFrame
    log: runlog.RunLog
    curve: DataFrame | None = None

    def write(self, folder: str) -> None:
        """Metrics and modes as bundles, tables as CSV, and the log."""
        results.write_bundle(self.metrics, f"{folder}/metrics")
        results.write_bundle(self.modes, f"{folder}/modes")
        results.write_bundle(self.independent, f"{folder}/independent")
        results.write_table(self.fold_accuracies, f"{folder}/fold_accuracies")
        if self.curve is not None:
            results.write_table(self.curve, f"{folder}/curve")
        self.log.write(self.metrics.sparkSession, f"{folder}/log")


def build(recordings: DataFrame, key: str, fs: float, seconds: float, overlap: float, alpha: float, mode: str, log: runlog.RunLog) -> DataFrame:
    """(row_id, key, label, segment_index, n_modes, f) of recordings (key, label, signal): cleaned, cut, decomposed, summed up.

    Every window has a row; one whose decomposition failed has zeros. Rows are numbered by key and window."""
    size, step = segments.size_and_step(seconds, fs, overlap)
    clean = log.keep("preprocess", signals.preprocess(recordings.select(key, "label", "signal"), mode, fs=fs))
    cut = log.keep("windows", segments.array_windows(clean, size, step))
    own = [key, "segment_index"]
    found = log.keep("modes_and_features", decompose.feature_vectors(cut, own, fs, Settings(alpha=alpha)), failed=F.count_if(F.col("error").isNotNull()))
    width = cut.agg(F.max(F.size("signal") * 9)).first()[0] or 0
    full = energy.complete(cut.select(key, "label", "segment_index"), found.select(*own, "n_modes", "f"), own, width)
    number = F.sum("n").over(segments.Window.orderBy(key).rowsBetween(segments.Window.unboundedPreceding, -1))
    # One row a recording: its windows, and how many there are before it.
    before = full.groupBy(key).agg(F.count("*").alias("n")).select(key, F.coalesce(number, F.lit(0)).alias("before"))
    return log.keep("energy_integration", full.join(before, key).withColumn("row_id", F.col("before") + F.col("segment_index") + 1).drop("before"))


def run(recordings: DataFrame, key: str, e: Experiment, fs: float, seconds: float = 5.0, overlap: float = 0.5, mode: str = "B", count: int = 10, curve: list[int] | None = None, method: str = "F", name: str = "run") -> Outcome:
    """One experiment over recordings (key, label, signal)."""
    log = runlog.RunLog(name)
    return judge(build(recordings, key, fs, seconds, overlap, e.alpha, mode, log), key, e, log, count, curve, method)


def judge(matrix: DataFrame, key: str, e: Experiment, log: runlog.RunLog, count: int = 10, curve: list[int] | None = None, method: str = "F") -> Outcome:
    """An experiment over a matrix of windows: folds of windows with ranking and scaling inside each fold, folds of whole
    subjects, how many modes windows have, and the accuracy by number of features for the counts in `curve`."""
    folded = log.keep("folds", folds.shuffled(matrix.select("row_id", key, "label", "f"), count))
    predicted = log.keep("windows_apart", lambda: experiments.evaluate(folded, e.k, e.metric, e.weights, e.keep, e.standardise, method), right=F.count_if(F.col("label") == F.col("predicted")))
    apart = experiments.subject_independent(matrix.select("row_id", key, "label", "f"), key, count)
    independent = log.keep("subjects_apart", lambda: experiments.evaluate(apart, e.k, e.metric, e.weights, e.keep, e.standardise, method))
    per_fold = predicted.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    curved = experiments.sweep(folded, selection.rank(matrix, method, max(curve)), curve, e.k, e.metric, e.weights) if curve else None
    cap = Settings(alpha=e.alpha).max_modes
    modes = matrix.agg(F.count("*").alias("windows"), F.countDistinct(key).alias("subjects"), F.avg("n_modes").alias("mean"), F.min("n_modes").alias("least"), F.max("n_modes").alias("most"), F.count_if(F.col("n_modes") >= cap).alias("at_cap"))
    measured = metrics.binary_metrics(metrics.binary_counts(predicted))
    return Outcome(matrix, predicted, measured, per_fold, metrics.binary_metrics(metrics.binary_counts(independent)), modes, log, curved)
