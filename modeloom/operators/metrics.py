"""Metrics over predictions (label, predicted), all from the table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.operators.stats import running

# Published results to compare with, and the tolerance of the comparison.
TARGETS = {
    "DS1_Rest": {"accuracy": 1.00, "precision": 1.00, "recall": 1.00, "f1": 1.00},
    "DS1_Music": {"accuracy": 1.00, "precision": 1.00, "recall": 1.00, "f1": 1.00},
    "DS1_RestMusic": {"accuracy": 1.00, "precision": 1.00, "recall": 1.00, "f1": 1.00},
    "DS2": {"accuracy": 0.9917, "precision": 0.9904, "recall": 0.9907, "f1": 0.9905, "mcc": 0.983, "kappa": 0.983, "gdr": 99.239, "gmean": 0.9915},
}
TOLERANCE = 0.005


def confusion(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, label, predicted, n)."""
    return predictions.groupBy(*(by or []), "label", "predicted").agg(F.count("*").alias("n"))


def binary_counts(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    hit = lambda y, p: F.count_if((F.col("label") == y) & (F.col("predicted") == p))
    return predictions.groupBy(*(by or [])).agg(hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(1, 1).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def binary_metrics(counts: DataFrame) -> DataFrame:
    """All metrics of counts tn, fp, fn, tp; a ratio over nothing is 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n, negative, positive = tn + fp + fn + tp, tn + fp, fn + tp
    recall0, recall1 = _ratio(tn, negative), _ratio(tp, positive)
    precision0, precision1 = _ratio(tn, tn + fn), _ratio(tp, tp + fp)
    f0, f1 = _ratio(2 * precision0 * recall0, precision0 + recall0), _ratio(2 * precision1 * recall1, precision1 + recall1)
    mean = lambda a, b: (a * negative + b * positive) / n
    chance = (negative * (tn + fn) + positive * (tp + fp)) / (n * n)
    accuracy = (tn + tp) / n
    return counts.withColumns({
        "accuracy": accuracy, "precision": mean(precision0, precision1), "recall": mean(recall0, recall1), "f1": mean(f0, f1), "balanced_accuracy": (recall0 + recall1) / 2,
        "mcc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "kappa": _ratio(accuracy - chance, 1 - chance),
        "gdr": F.sqrt(recall0 * recall1) * 100, "gmean": F.sqrt(tp / (positive + 1e-10) * (tn / (negative + 1e-10))),
    })


def weighted_metrics(predictions: DataFrame) -> DataFrame:
    """Accuracy and means over classes weighted by support, for any number of classes."""
    table = confusion(predictions)
    by_label = table.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    by_predicted = table.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("named"))
    each = by_label.join(by_predicted, "c", "left").withColumn("p", _ratio(F.col("hits"), F.coalesce("named", F.lit(0)))).withColumn("r", _ratio(F.col("hits"), F.col("support")))
    each = each.withColumn("f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return each.agg((F.sum("hits") / F.sum("support")).alias("accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"), F.avg("r").alias("balanced_accuracy"))


def roc_points(scores: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, tp, fp, tpr, fpr) for each distinct score as a threshold, from the greatest down. Running sums go over distinct scores."""
    steps = scores.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    totals = steps.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    run = running(steps, score, {"tp": "p", "fp": "q"}, descending=True).join(F.broadcast(totals))
    return run.select(score, "tp", "fp", _ratio(F.col("tp"), F.col("np")).alias("tpr"), _ratio(F.col("fp"), F.col("nq")).alias("fpr"), "p", "q", "np", "nq")


def areas(points: DataFrame) -> DataFrame:
    """Area under the ROC curve by trapezia, and average precision. A step's own counts tell where the one before ended."""
    roc = _ratio(F.col("q"), F.col("nq")) * _ratio(2 * F.col("tp") - F.col("p"), F.col("np")) / 2
    return points.agg(F.sum(roc).alias("roc_auc"), F.sum(_ratio(F.col("tp"), F.col("tp") + F.col("fp")) * _ratio(F.col("p"), F.col("np"))).alias("pr_auc"))


def majority_vote(predictions: DataFrame, subject: str) -> DataFrame:
    """A row a subject: its label (the more frequent, of equal ones the less), and 1 if over half of its windows are predicted 1."""
    share = F.avg((F.col("predicted") == 1).cast("double"))
    ones = F.avg((F.col("label") == 1).cast("double"))
    out = predictions.groupBy(subject).agg(
        F.when(ones > 0.5, 1).otherwise(0).alias("label"), F.count("*").alias("n_segments"), F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("segment_accuracy"),
        share.alias("fraction_predicted"), F.when(share > 0.5, 1).otherwise(0).alias("majority_vote"), (share == 0.5).alias("tie"),
    )
    return out.withColumn("vote_correct", (F.col("majority_vote") == F.col("label")).cast("int"))


def vote_summary(subjects: DataFrame) -> DataFrame:
    a = F.col("segment_accuracy")
    return subjects.agg(
        F.count("*").alias("n_subjects"), F.sum("vote_correct").alias("votes_correct"), F.avg("vote_correct").alias("vote_accuracy"), F.count_if("tie").alias("ties"),
        F.count_if(a < 0.5).alias("n_below_half"), F.count_if(a == 0).alias("n_zero"), F.count_if(a == 1).alias("n_perfect"), F.min(a).alias("low"), F.max(a).alias("high"), F.median(a).alias("median"),
    )


def fold_summary(predictions: DataFrame) -> DataFrame:
    each = predictions.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return each.agg(F.count("*").alias("n_folds"), F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"))


def row_shares(table: DataFrame) -> DataFrame:
    """Counts as percentages of their true class."""
    return table.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("label")))


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, m, v) for e, row in TARGETS.items() for m, v in row.items()], "experiment string, metric string, target double")


def compare(found: DataFrame, wanted: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(experiment, metric, value) beside their targets."""
    joined = found.join(wanted, ["experiment", "metric"])
    return joined.withColumn("diff", F.col("value") - F.col("target")).withColumn("matches", F.abs("diff") < tolerance)
