"""Neighbour information over ranges, against one array."""

import numpy as np
import pytest

from modeloom.functions.information import digamma, with_class
from modeloom.operators import selection


def table(spark, n=240, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    f = np.stack([rng.normal(size=n) + y, rng.normal(size=n), np.round(rng.normal(size=n), 1), np.zeros(n), rng.exponential(size=n) * (1 + y)], axis=1)
    rows = [(i, int(y[i]) if i else 9, f[i].tolist()) for i in range(n)]
    rows += [(1000 + i, 7, f[i].tolist()) for i in range(2)]
    return spark.createDataFrame(rows, "row_id long, label int, f array<double>").repartition(3)


@pytest.mark.parametrize("k, most, each", [(3, 256, 1 << 16), (3, 256, 20), (3, 40, 7), (5, 3, 12), (1, 500, 3)])
def test_relevance_is_that_of_one_array(spark, k, most, each):
    rows = table(spark)
    values = selection.traced(rows, "label", 42).toPandas()
    wanted = {int(f): with_class(g["x"].to_numpy(float), g["label"].to_numpy(), k) for f, g in values.groupby("feat")}
    found = {r["feat"]: r["mi"] for r in selection.neighbour_relevance(rows, k=k, most_ranges=most, rows_each=each).collect()}
    assert found == {f: pytest.approx(v, abs=1e-8) for f, v in wanted.items()}
    assert found[0] > found[1] + 0.1 or k == 1


def test_no_class_of_two_rows(spark):
    rows = spark.createDataFrame([(i, i, [1.0 * i, 2.0]) for i in range(4)], "row_id long, label int, f array<double>")
    assert {r["mi"] for r in selection.neighbour_relevance(rows).collect()} <= {0.0}
    assert selection.neighbour_relevance(rows.limit(0)).count() == 0


def test_digamma(spark):
    rows = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 10, 1000)], "x double")
    found = [r[0] for r in rows.select(selection.digamma(rows["x"])).collect()]
    assert np.allclose(found, digamma(np.array([1.0, 2, 3, 10, 1000])), atol=1e-8)


def test_numbers_over_ranges(spark):
    from modeloom.sources.shared import numbered

    words = [f"w{(i * 7919) % 1000:04d}" for i in range(1000)] + ["w0000", "w0500"]
    rows = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i int").repartition(6)
    found = {r["i"]: r["number"] for r in numbered(rows, "w", "i").collect()}
    assert found == {i: n for n, (_, i) in enumerate(sorted((w, i) for i, w in enumerate(words)))}
    assert numbered(rows.limit(0), "w").count() == 0


def test_ranks_outside_folds_are_ranks_of_the_others(spark):
    from pyspark.sql import functions as F

    rows = table(spark).filter("label < 3").withColumn("fold", (F.col("row_id") % 4).cast("int"))
    wanted = {f: selection.rank(rows.filter(F.col("fold") != f), "F", 4) for f in range(4)}
    assert selection.ranks_outside(rows, 4) == wanted
