"""Descriptive statistics of groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running(steps: DataFrame, key: str, sums: dict[str, str], descending: bool = False, ranges: int = 64) -> DataFrame:
    """Adds running sums of columns (result to source) in the order of a numeric key whose values are distinct.

    Ranges of the key are summed up apart; what lies before a range comes from a table of at most `ranges` rows, so no
    task gets all rows."""
    bounds = sorted(set(steps.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.001)))
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(key))) if bounds else F.lit(0)
    sign = -1 if descending else 1
    dealt = steps.withColumn("__range", above * sign)
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *[F.coalesce(F.sum(f"__{out}").over(before), F.lit(0)).alias(f"__{out}") for out in sums])
    within = Window.partitionBy("__range").orderBy(F.desc(key) if descending else key).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(offsets), "__range")
    return joined.select(*steps.columns, *[(F.col(f"__{out}") + F.sum(c).over(within)).alias(out) for out, c in sums.items()])


def rank_sums(values: DataFrame, group: str = "label", value: str = "v") -> DataFrame:
    """One row for two groups 0 and 1: sizes, U of group 1, and the sum of t**3 - t over ties. Ranks go over distinct values."""
    steps = values.groupBy(value).agg(F.count_if(F.col(group) == 1).alias("a"), F.count("*").alias("t"))
    ranked = running(steps, value, {"upto": "t"}).withColumn("rank", F.col("upto") - F.col("t") + (F.col("t") + 1) / 2)
    out = ranked.agg(F.sum("a").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    return out.select("n1", (F.col("n") - F.col("n1")).alias("n0"), (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u"), "ties")


def mann_whitney(values: DataFrame, group: str = "label", value: str = "v") -> tuple[float, float]:
    """U of group 1, and the two-sided p by the normal law with corrections for ties and continuity."""
    r = rank_sums(values, group, value).first()
    n1, n0, u = r["n1"], r["n0"], float(r["u"])
    n = n1 + n0
    spread = math.sqrt(n1 * n0 / 12 * ((n + 1) - r["ties"] / (n * (n - 1))))
    z = (max(u, n1 * n0 - u) - n1 * n0 / 2 - 0.5) / spread
    return u, min(1.0, math.erfc(z / math.sqrt(2)))


def by_class(values: DataFrame, group: str = "label", value: str = "v") -> DataFrame:
    """Over all and for each group: n, mean, std, median, range; `group` is null for all."""
    v = F.col(value)
    return values.groupingSets([[], [F.col(group)]], F.col(group)).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


def histogram(values: DataFrame, group: str = "label", value: str = "v") -> DataFrame:
    """(group, bin, n, density) with bins of width 1 around whole numbers."""
    counts = values.groupBy(group, F.floor(F.col(value) + 0.5).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def dataset_counts(segments: DataFrame, subject: str = "subject", label: str = "label", pos: str = "pos") -> DataFrame:
    each = segments.groupBy(subject).agg(F.min(label).alias("y"), F.count("*").alias("n"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(pos) % 2 == 0).alias("even"))
    return each.agg(
        F.sum("n").alias("segments_total"), F.sum("n0").alias("segments_control"), (F.sum("n") - F.sum("n0")).alias("segments_disorder"), F.count("*").alias("subjects_total"),
        F.count_if(F.col("y") == 0).alias("subjects_control"), F.count_if(F.col("y") != 0).alias("subjects_disorder"), F.sum("even").alias("segments_overlap0"), F.min("n").alias("per_subject_min"), F.max("n").alias("per_subject_max"),
    )
