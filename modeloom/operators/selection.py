"""Ranking of features by relevance and redundancy.

Matrices are rows (row_id, label, f) with f an array. Tables over features have p rows and tables over pairs p * p, which
is small whatever the number of rows; the greedy choice between them runs on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.functions.information import continuous, greedy, prepared


def long_features(matrix: DataFrame, *keep: str, column: str = "f") -> DataFrame:
    """(row_id, keep, feat, v)."""
    return matrix.select("row_id", *keep, F.posexplode(column).alias("feat", "v"))


def anova(matrix: DataFrame, label: str = "label") -> DataFrame:
    """(feat, f_score): variance between classes over that within, 0 where there is none within."""
    groups = long_features(matrix, label).groupBy("feat", label).agg(F.count("*").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("*")).alias("ss"))
    total = groups.groupBy("feat").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    joined = groups.join(total, "feat").groupBy("feat").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"), F.sum("ss").alias("within"), F.count("*").alias("k"), F.sum("n").alias("n")
    )
    score = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
    return joined.select("feat", F.when((F.col("within") > 0) & (F.col("k") > 1) & (F.col("n") > F.col("k")), score).otherwise(0.0).alias("f_score"))


def correlations(matrix: DataFrame, column: str = "f") -> DataFrame:
    """(a, b, r) for a < b: each partition multiplies its centred rows, and only p * p sums of it are shuffled."""
    means = np.array([r["m"] for r in long_features(matrix, column=column).groupBy("feat").agg(F.avg("v").alias("m")).orderBy("feat").collect()])

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(means), len(means)))
        for f in frames:
            for i in range(0, len(f), 1024):
                x = np.stack(f[column].iloc[i : i + 1024].to_numpy()).astype(float) - means
                total += x.T @ x
        at = np.triu_indices(len(means))
        yield pd.DataFrame({"a": at[0], "b": at[1], "s": total[at]})

    sums = matrix.select(column).mapInPandas(products, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s"))
    own = sums.filter("a = b")
    left, right = own.select("a", F.col("s").alias("sa")), own.select("b", F.col("s").alias("sb"))
    spread = F.sqrt(F.col("sa") * F.col("sb"))
    return sums.filter("a < b").join(F.broadcast(left), "a").join(F.broadcast(right), "b").select("a", "b", F.when(spread > 0, F.col("s") / spread).alias("r"))


def binned_information(matrix: DataFrame, pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(a, b, mi) of pairs (a, b) of features: mutual information of `bins` equally spaced edges."""
    values = long_features(matrix)
    span = values.groupBy("feat").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    wide = (F.col("high") - F.col("low")) / (bins - 1)
    edge = F.when(wide > 0, F.greatest(F.lit(1), F.least(F.lit(bins), F.floor((F.col("v") - F.col("low")) / wide) + 1))).otherwise(F.lit(bins))
    binned = values.join(F.broadcast(span), "feat").select("row_id", "feat", F.when(F.col("v") >= F.col("high"), bins).otherwise(edge).cast("int").alias("bin"))
    left = binned.select("row_id", F.col("feat").alias("a"), F.col("bin").alias("i"))
    right = binned.select("row_id", F.col("feat").alias("b"), F.col("bin").alias("j"))
    joint = left.join(F.broadcast(pairs), "a").join(right, ["row_id", "b"]).groupBy("a", "b", "i", "j").agg(F.count("*").alias("n"))
    n = joint.groupBy("a", "b").agg(F.sum("n").alias("total"))
    by_i, by_j = joint.groupBy("a", "b", "i").agg(F.sum("n").alias("ni")), joint.groupBy("a", "b", "j").agg(F.sum("n").alias("nj"))
    cells = joint.join(n, ["a", "b"]).join(by_i, ["a", "b", "i"]).join(by_j, ["a", "b", "j"])
    term = F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("ni") * F.col("nj")))
    return cells.groupBy("a", "b").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("mi"))


#: Values are whole numbers of this many parts of a deviation, so that differences are exact.
PARTS = 1e13


def digamma(x: Column) -> Column:
    """Of counts: the asymptotic series six steps on, and back."""
    y = x + 6.0
    return F.ln(y) - 0.5 / y - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - 1 / (252 * y * y * y * y * y * y) - sum((1 / (x + float(i)) for i in range(6)), F.lit(0.0))


def traced(matrix: DataFrame, label: str, seed: int) -> DataFrame:
    """(feat, label, x): values by their feature's deviation, with a trace of normal noise against ties that follows from the row, as whole numbers."""
    values = long_features(matrix, label)
    spread = values.groupBy("feat").agg(F.stddev_pop("v").alias("sd"), F.avg(F.abs("v")).alias("size")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    digest = F.md5(F.concat_ws("|", "row_id", "feat", F.lit(seed)))
    uniform = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    noise = F.sqrt(-2 * F.ln(uniform(1))) * F.cos(2 * np.pi * uniform(9))
    x = F.col("v") / F.col("sd") + 1e-10 * F.greatest(F.lit(1.0), F.col("size") / F.col("sd")) * noise
    return values.join(F.broadcast(spread), "feat").select("feat", F.col(label).alias("label"), F.round(x * PARTS).cast("long").alias("x"))


def in_ranges(frame: DataFrame, bounds: DataFrame, value: str) -> DataFrame:
    """Adds `range`, how many of its feature's bounds lie below a value."""
    return frame.join(F.broadcast(bounds), "feat").withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col(value)))).drop("bounds")


def neighbour_relevance(matrix: DataFrame, label: str = "label", k: int = 3, seed: int = 42, most_ranges: int = 256, rows_each: int = 1 << 16, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(feat, mi): information on the class by nearest neighbours; `keep` writes or caches the values, which are read several times.

    A feature's values are dealt to ranges of about `rows_each` rows, at most `most_ranges` of them. Ranks within a class come
    from ranks within a range and the counts of ranges before; blocks of ranks with a halo of k rows at each side then hold all
    neighbours of their rows. How many rows of any class lie nearer than the k-th of the own class is a difference of two
    running counts over the same ranges. So no task has all rows of a feature."""
    values = traced(matrix, label, seed)
    values = keep(values) if keep else values
    counts = values.groupBy("feat", "label").agg(F.count("*").alias("own")).filter("own > 1")
    totals = counts.groupBy("feat").agg(F.sum("own").alias("n"))
    n = totals.agg(F.max("n")).first()[0]
    if n is None:
        return matrix.sparkSession.range(0).select(F.col("id").cast("int").alias("feat"), F.lit(0.0).alias("mi"))
    ranges = max(1, min(most_ranges, -(-n // rows_each)))
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = values.groupBy("feat").agg((F.percentile_approx("x", cuts) if cuts else F.array().cast("array<long>")).alias("bounds"))
    dealt = in_ranges(values.join(F.broadcast(counts), ["feat", "label"]), bounds, "x")

    before = Window.partitionBy("feat", "label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("feat", "label", "range").agg(F.count("*").alias("c")).select("feat", "label", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("feat", "label", "range").orderBy("x")) - 1
    ranked = dealt.join(F.broadcast(offsets), ["feat", "label", "range"]).withColumn("rank", rank)
    size = F.lit(max(rows_each, 2 * k + 1))
    block, at = F.floor(F.col("rank") / size), F.col("rank") % size
    homes = F.array_compact(F.array(block, F.when(at < k, block - 1), F.when(at >= size - k, block + 1)))
    spread = ranked.select("feat", "label", "own", "x", "rank", block.alias("home"), F.explode(homes).alias("block"))
    order = Window.partitionBy("feat", "label", "block").orderBy("rank")
    # The k-th nearest of a sorted list is the end of one of the k + 1 runs around a value; a class of fewer rows has a nearer last one.
    near = F.least(F.lit(k), F.col("own") - 1)
    reach = [F.col("x") - F.lag("x", j).over(order) if j else F.lit(0).cast("long") for j in range(k + 1)], [F.lead("x", j).over(order) - F.col("x") if j else F.lit(0).cast("long") for j in range(k + 1)]
    names = [f"__{side}{j}" for side in "lr" for j in range(k + 1)]
    reached = spread.select("*", near.alias("near"), *[c.alias(x) for x, c in zip(names, [*reach[0], *reach[1]], strict=True)]).filter("block = home")
    runs = [F.when((F.col("near") == m) & F.col(f"__l{j}").isNotNull() & F.col(f"__r{m - j}").isNotNull(), F.greatest(f"__l{j}", f"__r{m - j}")) for m in range(1, k + 1) for j in range(m + 1)]
    found = reached.select("feat", "label", "own", "x", "rank", "near", F.greatest(F.lit(1), F.least(*runs, F.lit(None).cast("long"))).alias("d"))

    each = F.explode(F.array(F.struct((F.col("x") + F.col("d") - 1).alias("at"), F.lit(1).alias("sign")), F.struct((F.col("x") - F.col("d")).alias("at"), F.lit(-1).alias("sign"))))
    asked = found.select("feat", "label", "rank", "own", "near", each.alias("q")).select("feat", "label", "rank", "own", "near", F.col("q.at").alias("at"), F.col("q.sign").alias("sign"))
    held = dealt.select("feat", F.col("x").alias("at"), F.lit(0).alias("sign"))
    merged = in_ranges(asked.unionByName(held, allowMissingColumns=True), bounds, "at")
    under = Window.partitionBy("feat").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    passed = dealt.groupBy("feat", "range").agg(F.count("*").alias("c"))
    every = bounds.select("feat", F.explode(F.sequence(F.lit(0), F.size("bounds"))).alias("range")).join(passed, ["feat", "range"], "left")
    passed = every.select("feat", "range", F.coalesce(F.sum("c").over(under), F.lit(0)).alias("passed"))
    upto = Window.partitionBy("feat", "range").orderBy("at", F.abs("sign")).rowsBetween(Window.unboundedPreceding, 0)
    placed = merged.withColumn("inside", F.count_if(F.col("sign") == 0).over(upto)).filter("sign != 0").join(F.broadcast(passed), ["feat", "range"])
    within = placed.groupBy("feat", "label", "rank").agg(F.sum(F.col("sign") * (F.col("inside") + F.col("passed"))).alias("m"), F.first("own").alias("own"), F.first("near").alias("near"))
    sums = within.groupBy("feat").agg(F.avg(digamma(F.col("near"))).alias("a"), F.avg(digamma(F.col("own"))).alias("b"), F.avg(digamma(F.greatest(F.lit(1), F.col("m")))).alias("c"), F.count("*").alias("n"))
    informed = sums.select("feat", F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("a") - F.col("b") - F.col("c")).alias("mi"))
    return values.select("feat").distinct().join(informed, "feat", "left").select("feat", F.coalesce("mi", F.lit(0.0)).alias("mi"))


def neighbour_redundancy(matrix: DataFrame, sample_rows: int = 2000, seed: int = 42, column: str = "f") -> DataFrame:
    """(a, b, mi) for a < b on the `sample_rows` rows with the least id hashes; pairs are spread over tasks, the sample is broadcast."""
    spark = matrix.sparkSession
    rows = matrix.orderBy(F.xxhash64("row_id", F.lit(seed)), "row_id").limit(sample_rows).select(column).collect()
    sample = np.array([r[0] for r in rows], float)
    p = sample.shape[1] if len(sample) else 0
    shared = spark.sparkContext.broadcast(prepared(sample, np.random.RandomState(seed)) if p else sample)
    every = spark.range(p * p).select((F.col("id") / p).cast("int").alias("a"), (F.col("id") % p).cast("int").alias("b")) if p else spark.createDataFrame([], "a int, b int")

    def run(frames):
        x = shared.value
        for f in frames:
            yield f.assign(mi=[continuous(x[:, a], x[:, b]) for a, b in zip(f["a"], f["b"], strict=True)])

    return every.filter("a < b").repartition(max(1, spark.sparkContext.defaultParallelism)).mapInPandas(run, "a int, b int, mi double")


def select(relevance: DataFrame, redundancy: DataFrame, score: str, load: str, count: int | None = None) -> list[int]:
    """Feature numbers in the order of choice."""
    rel = {r["feat"]: r[score] or 0.0 for r in relevance.select("feat", score).collect()}
    p = max(rel, default=-1) + 1
    red = np.zeros((p, p))
    for r in redundancy.select("a", "b", load).collect():
        red[r["a"], r["b"]] = red[r["b"], r["a"]] = abs(r[load] or 0.0)
    return greedy(np.array([rel.get(i, 0.0) for i in range(p)]), red, count)


def rank(matrix: DataFrame, method: str = "MI", count: int | None = None, label: str = "label") -> list[int]:
    """By neighbours' information (MI) or by variance and correlation (F)."""
    if method == "MI":
        return select(neighbour_relevance(matrix, label), neighbour_redundancy(matrix), "mi", "mi", count)
    if method == "F":
        return select(anova(matrix, label), correlations(matrix), "f_score", "r", count)
    raise ValueError(f"method {method!r} is neither MI nor F")


def ranks_outside(rows: DataFrame, count: int | None = None) -> dict[int, list[int]]:
    """Of each fold of rows (row_id, label, fold, f) the order that `rank` by F gives on the rows outside it.

    One pass adds up each fold's counts, sums and products; what lies outside a fold is the total less its own. The driver
    gets a table over pairs of features for each fold."""
    means = np.array([r["m"] for r in long_features(rows).groupBy("feat").agg(F.avg("v").alias("m")).orderBy("feat").collect()])
    p = len(means)
    upper = np.triu_indices(p)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        singles: dict[tuple, np.ndarray] = {}
        products: dict[int, np.ndarray] = {}
        for frame in frames:
            for (fold, label), part in frame.groupby(["fold", "label"]):
                x = np.stack(part["f"].to_numpy()).astype(float) - means
                singles[fold, label] = singles.get((fold, label), 0) + np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
                products[fold] = products.get(fold, 0) + x.T @ x
        for (fold, label), v in singles.items():
            yield pd.DataFrame({"fold": fold, "label": label, "pairs": False, "at": np.arange(len(v)), "s": v})
        for fold, v in products.items():
            yield pd.DataFrame({"fold": fold, "label": 0, "pairs": True, "at": np.arange(len(upper[0])), "s": v[upper]})

    table = rows.select("fold", "label", "f").mapInPandas(sums, "fold long, label long, pairs boolean, at int, s double").groupBy("fold", "label", "pairs", "at").agg(F.sum("s").alias("s")).toPandas()
    wide = lambda part: {k: g.sort_values("at")["s"].to_numpy() for k, g in part.groupby(["fold", "label"])}
    singles, products = wide(table[~table["pairs"]]), {k[0]: v for k, v in wide(table[table["pairs"]]).items()}
    labels, out = sorted({k[1] for k in singles}), {}
    every = {c: sum(v for k, v in singles.items() if k[1] == c) for c in labels}
    for fold, own in products.items():
        left = [v for c in labels if (v := every[c] - singles.get((fold, c), 0))[0] > 0.5]
        n, s, q = (np.array([v[0] for v in left]), np.array([v[1 : p + 1] for v in left]).reshape(-1, p), np.array([v[p + 1 :] for v in left]).reshape(-1, p))
        total, mean = n.sum(), s.sum(axis=0) / max(n.sum(), 1)
        within = (q - s * s / n[:, None]).sum(axis=0)
        between = (n[:, None] * (s / n[:, None] - mean) ** 2).sum(axis=0)
        with np.errstate(all="ignore"):
            score = np.where((within > 1e-12 * np.maximum(q.sum(axis=0), 1e-300)) & (len(left) > 1) & (total > len(left)), (between / (len(left) - 1)) / (within / (total - len(left))), 0.0) if total else np.zeros(p)
            shared = np.zeros((p, p))
            shared[upper] = sum(products.values()) - own
            shared = shared + np.triu(shared, 1).T - total * np.outer(mean, mean)
            spread = np.sqrt(np.outer(np.diag(shared), np.diag(shared)))
            related = np.where(spread > 0, np.abs(shared / spread), 0.0)
        out[int(fold)] = greedy(score, np.nan_to_num(related), count)
    return out


def project(matrix: DataFrame, chosen: list[int], column: str = "f") -> DataFrame:
    return matrix.withColumn(column, F.array(*[F.get(column, F.lit(int(i))) for i in chosen]))


def sweep_counts(p: int) -> list[int]:
    """1 to 50, then every fifth, and all."""
    return sorted({*range(1, min(50, p) + 1), *range(55, p + 1, 5), p} - {0})


def smallest_best(curve: DataFrame) -> DataFrame:
    """The least number of features among those of the greatest accuracy."""
    return curve.orderBy(F.desc("cv_accuracy"), "n_features").limit(1)


@dataclass
class Selector:
    """Keeps the first `count` features of a fixed order, or of one that `fit` finds; with as many as there are, all stay and nothing is ranked."""

    count: int
    method: str = "F"
    order: list[int] | None = None
    chosen: list[int] | None = None

    def fit(self, matrix: DataFrame) -> Selector:
        first = matrix.select(F.size("f")).first()
        if not first or self.count >= first[0]:
            self.chosen = None
        else:
            self.chosen = (self.order or rank(matrix, self.method, self.count))[: self.count]
        return self

    def transform(self, matrix: DataFrame) -> DataFrame:
        return matrix if self.chosen is None else project(matrix, self.chosen)
