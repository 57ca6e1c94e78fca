import pytest
from pyspark.sql import functions as F

from modeloom.operators import metrics, segments, stats

PUBLISHED = {(2408, 500, 435, 3245): {"accuracy": 0.858075, "precision": 0.857883, "recall": 0.858075, "f1": 0.857894, "mcc": 0.711665, "kappa": 0.711522, "gdr": 85.450475, "gmean": 0.854505}}


def test_published_metrics(spark):
    for counts, wanted in PUBLISHED.items():
        row = metrics.binary_metrics(spark.createDataFrame([counts], "tn long, fp long, fn long, tp long")).first()
        for name, value in wanted.items():
            assert row[name] == pytest.approx(value, abs=1e-6), name


@pytest.mark.parametrize("length, count", [(639, 0), (640, 1), (641, 1), (960, 1), (961, 2), (14304, 43), (15360, 46), (15361, 47)])
def test_window_counts(spark, length, count):
    assert spark.range(1).select(segments.count_of(F.lit(length), 640, 320)).first()[0] == count


def test_overlap_must_lie_between():
    assert segments.size_and_step(5, 128.0, 0.5) == (640, 320)
    for bad in (0, 1):
        with pytest.raises(ValueError):
            segments.size_and_step(5, 128.0, bad)


def test_majority_vote_ties_go_to_control(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0)], "s int, label int, predicted int")
    found = {r["s"]: r for r in metrics.majority_vote(rows, "s").collect()}
    assert found[1]["majority_vote"] == 0 and found[1]["tie"] and found[1]["vote_correct"] == 0 and found[2]["vote_correct"] == 1


def test_mann_whitney_by_counting(spark):
    a, b = [1, 2, 2, 5], [2, 3, 4]
    rows = spark.createDataFrame([(1, float(x)) for x in a] + [(0, float(x)) for x in b], "label int, v double")
    u, p = stats.mann_whitney(rows)
    assert u == sum((x > y) + 0.5 * (x == y) for x in a for y in b) and 0 < p <= 1
