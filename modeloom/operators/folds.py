"""Folds as a column `fold`, which replaces any that rows already have."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.functions import splits


def _in_turn(rows: DataFrame, folds: int, label: str, order: Column, part: Column) -> DataFrame:
    """Each class dealt out in turn by `order`. `part` rises with it and cuts a class into parts that are numbered apart;
    what lies before a part is summed up over counts, so no task numbers a whole class."""
    cut = rows.drop("fold").withColumn("__order", order).withColumn("__part", part)
    before = Window.partitionBy(label).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(label, "__part").count().select(label, "__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(label, "__part").orderBy("__order")
    number = F.col("__before") + F.row_number().over(within) - 1
    return cut.join(counts, [label, "__part"]).withColumn("fold", F.pmod(number, F.lit(folds))).drop("__order", "__part", "__before")


def dealt(rows: DataFrame, folds: int, label: str = "label", ranges: int = 64) -> DataFrame:
    """Each class dealt out in turn, by row_id."""
    bounds = sorted(set(rows.approxQuantile("row_id", [i / ranges for i in range(1, ranges)], 0.001)))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("row_id"))) if bounds else F.lit(0)
    return _in_turn(rows, folds, label, F.col("row_id"), part)


def shuffled(rows: DataFrame, folds: int = 10, seed: int = 42, label: str = "label") -> DataFrame:
    """Each class dealt out in turn, in the order of a hash of seed and row_id: even class shares for tables of any size."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("row_id").cast("string")).cast("binary"))
    return _in_turn(rows, folds, label, digest, F.substring(digest, 1, 3))


def leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """A fold for each group."""
    rows = rows.drop("fold")
    names = rows.select(group).distinct().withColumn("fold", F.row_number().over(Window.orderBy(group)) - 1)
    return rows.join(names, group)


def _on_driver(rows: DataFrame, columns: list[str], assign: Callable[..., np.ndarray]) -> DataFrame:
    """Folds that hang on the order of all rows: worked out on ids and labels, joined back."""
    rows = rows.drop("fold")
    table = rows.select("row_id", *columns).orderBy("row_id").toPandas()
    fold = assign(*[table[c].to_numpy() for c in columns])
    pairs = rows.sparkSession.createDataFrame([(int(i), int(f)) for i, f in zip(table["row_id"], fold, strict=True)], "row_id long, fold int")
    return rows.join(pairs, "row_id")


def stratified(rows: DataFrame, folds: int = 10, seed: int = 42, label: str = "label") -> DataFrame:
    """The shuffle of the published runs, which hangs on one stream of random numbers; `shuffled` is for large tables."""
    return _on_driver(rows, [label], lambda y: splits.stratified(y, folds, seed))


def _by_group(rows: DataFrame, group: str, label: str | None, assign) -> DataFrame:
    """Folds of whole groups hang on the counts of groups and classes only."""
    rows = rows.drop("fold")
    counts = rows.groupBy(group, *([label] if label else [])).count().toPandas()
    names = np.repeat(counts[group].to_numpy(), counts["count"])
    y = np.repeat(counts[label].to_numpy(), counts["count"]) if label else None
    fold = dict(zip(names.tolist(), assign(names, y).tolist(), strict=True))
    kind = dict(rows.dtypes)[group]
    table = rows.sparkSession.createDataFrame([(g, int(f)) for g, f in fold.items()], f"{group} {kind}, fold int")
    return rows.join(table, group)


def grouped(rows: DataFrame, group: str, folds: int = 10) -> DataFrame:
    return _by_group(rows, group, None, lambda g, _: splits.grouped(g, folds))


def stratified_grouped(rows: DataFrame, group: str, folds: int = 10, label: str = "label") -> DataFrame:
    return _by_group(rows, group, label, lambda g, y: splits.stratified_grouped(y, g, folds))
