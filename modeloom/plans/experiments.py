"""From recordings to metrics: the plans that put the operators together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.functions.smvmd import Settings
from modeloom.operators import decompose, energy, folds, metrics, neighbors, segments, selection, signals


@dataclass(frozen=True)
class Experiment:
    """Settings of one experiment."""

    dataset: str
    alpha: float
    keep: int
    k: int
    metric: str
    weights: str
    standardise: bool


# Settings of the published experiments.
EXPERIMENTS = {
    "DS1_Rest": Experiment("DS1", 2000, 80, 2, "cityblock", "uniform", True),
    "DS1_Music": Experiment("DS1", 2000, 47, 2, "cityblock", "squared_inverse", False),
    "DS1_RestMusic": Experiment("DS1", 2000, 103, 1, "euclidean", "squared_inverse", True),
    "DS2": Experiment("DS2", 1000, 171, 2, "cosine", "squared_inverse", False),
}


def features(recordings: DataFrame, keys: list[str], fs: float, seconds: float, overlap: float, settings: Settings, mode: str = "B") -> DataFrame:
    """(row_id, keys, segment_index, n_modes, f): cleaned, cut, decomposed and summed up, all row by row but the numbering."""
    size, step = segments.size_and_step(seconds, fs, overlap)
    cut = segments.array_windows(signals.preprocess(recordings, mode, fs=fs), size, step)
    own = [*keys, "segment_index"]
    found = decompose.feature_vectors(cut, own, fs, settings)
    width = cut.select((F.size("signal") * 9).alias("w")).first()
    complete = energy.complete(found.select(*own, "n_modes"), found.select(*own, "f"), own, width["w"] if width else 0)
    # Rows are numbered in the order of recordings and segments: what lies before a recording is summed up over recordings.
    before = segments.Window.orderBy(*keys).rowsBetween(segments.Window.unboundedPreceding, -1)
    offsets = complete.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return complete.join(offsets, keys).withColumn("row_id", F.col("__before") + F.col("segment_index") + 1).drop("__before")


def evaluate(rows: DataFrame, k: int, metric: str, weights: str, keep: int | None = None, scale: bool = False, method: str = "F") -> DataFrame:
    """Predictions for (row_id, label, fold, f), each fold ranked, scaled and predicted by the others.

    Rankings are tables over features, one a fold; scaling and neighbours of all folds are one plan, in which a row is there
    once for each fold. Without ranking and scaling a row is the same in all folds and is there once."""
    if not rows.take(1):
        return rows.drop("f").withColumn("predicted", F.col("label"))
    p = rows.select(F.size("f")).first()[0]
    ranked = keep is not None and keep < p
    if not ranked and not scale:
        return neighbors.classify(rows, k, metric, weights)
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    each = neighbors.standardise(rows) if scale else rows.withColumn("in_fold", F.explode(F.array(*[F.lit(f).cast(rows.schema["fold"].dataType) for f in folds])))
    if ranked:
        chosen = selection.ranks_outside(rows, keep) if method == "F" else {f: selection.rank(rows.filter(F.col("fold") != f), method, keep) for f in folds}
        table = rows.sparkSession.createDataFrame([(f, [int(i) for i in c]) for f, c in chosen.items()], "__fold long, __chosen array<int>")
        each = each.join(F.broadcast(table), F.col("in_fold").cast("long") == F.col("__fold")).withColumn("f", F.transform("__chosen", lambda i: F.get("f", i))).drop("__fold", "__chosen")
    return neighbors.classify(each, k, metric, weights, by="in_fold").drop("in_fold")


def report(predictions: DataFrame, subject: str) -> dict[str, DataFrame]:
    """Metrics of windows, of folds, of subjects and over subjects."""
    voted = metrics.majority_vote(predictions, subject)
    return {"windows": metrics.binary_metrics(metrics.binary_counts(predictions)), "folds": metrics.fold_summary(predictions), "subjects": voted, "votes": metrics.vote_summary(voted)}


def sweep(rows: DataFrame, order: list[int], counts: list[int], k: int, metric: str, weights: str) -> DataFrame:
    """(n_features, cv_accuracy) for the first n features of an order; all counts and folds are one plan."""
    ordered = selection.project(rows.select("row_id", "label", "fold", "f"), order)
    voted = neighbors.vote(neighbors.neighbours_by_count(ordered, counts, k, metric), weights, ["task"])
    told = rows.select("row_id", "label", "fold").join(voted.withColumnRenamed("test_id", "row_id"), "row_id")
    folds = told.groupBy("task", "fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return folds.groupBy(F.col("task").cast("int").alias("n_features")).agg(F.avg("accuracy").alias("cv_accuracy"))


def subject_independent(rows: DataFrame, group: str, count: int = 10) -> DataFrame:
    """Folds of whole subjects: with even class shares if there are enough subjects of each class, else by size."""
    least = rows.select(group, "label").distinct().groupBy("label").count().agg(F.min("count")).first()[0] or 0
    return folds.stratified_grouped(rows, group, count) if least >= count else folds.grouped(rows, group, count)
