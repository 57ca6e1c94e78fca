"""Which components of a recording are artifacts, from where they are on the scalp and how they run in time."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.functions.ica import border

# Places of the electrodes (number, name, theta, radius, X, Y, Z).
ELECTRODES = (
    (1, "AF3", -22.5, 0.421, 76.2, 31.5, 20.8), (2, "F7", -53.9, 0.528, 49.9, 68.4, -7.49), (3, "F3", -39.9, 0.345, 57.6, 48.2, 39.9),
    (4, "FC5", -69.3, 0.408, 28.8, 76.2, 24.2), (5, "T7", -90.0, 0.533, 5.18e-15, 84.5, -8.85), (6, "P7", -126.0, 0.528, -49.9, 68.4, -7.49),
    (7, "O1", -162.0, 0.515, -80.8, 26.1, -4.0), (8, "O2", 162.0, 0.515, -80.8, -26.1, -4.0), (9, "P8", 126.0, 0.528, -49.9, -68.4, -7.49),
    (10, "T8", 90.0, 0.533, 5.18e-15, -84.5, -8.85), (11, "FC6", 69.3, 0.408, 28.8, -76.2, 24.2), (12, "F4", 39.9, 0.344, 57.6, -48.1, 39.9),
    (13, "F8", 53.9, 0.528, 49.9, -68.4, -7.49), (14, "AF4", 22.5, 0.421, 76.2, -31.5, 20.8),
)
FEATURES = ("kurtosis", "sed", "sad", "gdsf", "mev")


def electrodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(map(float, e[2:])) and (e[0], e[1], *map(float, e[2:])) for e in ELECTRODES], "number int, name string, theta double, radius double, x double, y double, z double")


def nearest(places: DataFrame, k: int = 10) -> DataFrame:
    """(number, other, d, r): of each electrode but the last the k nearest; of equally near ones the least number."""
    other = places.select(F.col("number").alias("other"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    last = places.agg(F.max("number").alias("last"))
    pairs = places.join(F.broadcast(last), F.col("number") < F.col("last")).join(F.broadcast(other), F.col("number") != F.col("other"))
    d = F.sqrt(sum(((F.col(c) - F.col(f"{c}2")) ** 2 for c in "xyz"), F.lit(0.0)))
    return pairs.select("number", "other", d.alias("d")).withColumn("r", F.row_number().over(Window.partitionBy("number").orderBy(F.round("d", 9), "other"))).filter(F.col("r") <= k)


def spatial(weights: DataFrame, places: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, sad, sed, left, right, diff_var, gdsf) of weights (by, number, w); `by` is `ic` where it isn't given."""
    by = by or ["ic"]
    joined = weights.join(F.broadcast(places), "number")
    theta, radius = F.col("theta"), F.col("radius")
    zones = {
        "front": (F.abs(theta) < 60) & (radius > 0.40), "back": F.abs(theta) > 110,
        "left": (theta > -61) & (theta < -35) & (radius > 0.30), "right": (theta > 34) & (theta < 61) & (radius > 0.30),
    }
    mean = lambda z: F.avg(F.when(zones[z], F.col("w")))
    var = lambda z: F.var_samp(F.when(zones[z], F.col("w")))
    flat = joined.groupBy(*by).agg((F.abs(mean("front")) - F.abs(mean("back"))).alias("sad"), F.abs(mean("left") - mean("right")).alias("sed"), mean("left").alias("left"), mean("right").alias("right"), (var("front") - var("back")).alias("diff_var"))
    near = F.broadcast(nearest(places)).join(weights.select(*by, F.col("number").alias("other"), F.col("w").alias("w2")), "other")
    around = near.groupBy(*by, "number").agg(F.avg(F.exp(-F.col("d")) * F.col("w2")).alias("around"))
    off = around.join(weights, [*by, "number"]).groupBy(*by).agg(F.max(F.abs(F.col("w") - F.col("around"))).alias("gdsf"))
    return flat.join(off, by)


def temporal(activity: DataFrame, trim: float = 0.01) -> DataFrame:
    """(ic, kurtosis, mev) of activity (ic, epoch, x): mean kurtosis of epochs, greatest over mean variance.

    Of more than 100 epochs the greatest share `trim` is left out."""
    return over_epochs(activity.groupBy("ic", "epoch").agg(F.kurtosis("x").alias("k"), F.var_samp("x").alias("v")), ["ic"], trim)


def over_epochs(each: DataFrame, by: list[str], trim: float = 0.01) -> DataFrame:
    """(by, kurtosis, mev) of epochs (by, epoch, k, v)."""
    n, of = F.count("*").over(Window.partitionBy(*by)), lambda c: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(c), "epoch"))
    ranked = each.withColumn("n", n).withColumn("rk", of("k")).withColumn("rv", of("v"))
    kept = lambda r, c: F.when((F.col("n") <= 100) | (F.col(r) > F.floor(F.col("n") * trim)), F.col(c))
    return ranked.groupBy(*by).agg(F.avg(kept("rk", "k")).alias("kurtosis"), F.try_divide(F.max(kept("rv", "v")), F.avg(kept("rv", "v"))).alias("mev"))


def two_class_limits(values: DataFrame, stop: float = 1e-4, max_iter: int = 10_000) -> dict[str, float]:
    """Of each feature of values (feature, v) the border of least error between a low and a high class, by expectation and
    maximisation: a step is one aggregate over all rows, and the driver holds six numbers a feature. Iteration ends as soon as
    any of the six moves by no more than `stop`; without a border it is mid-range."""
    frame = values.filter("v IS NOT NULL").select("feature", "v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        span = frame.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high")).withColumn("middle", (F.col("low") + F.col("high")) / 2)
        high, low = F.col("v") > F.col("middle") + 0.01 * (F.col("high") - F.col("middle")), F.col("v") < F.col("middle") - 0.01 * (F.col("middle") - F.col("low"))
        of = lambda side, f: f(F.when(side, F.col("v")))
        begun = frame.join(F.broadcast(span), "feature").groupBy("feature", "middle").agg(*[of(side, f).alias(f"{name}{k}") for k, side in enumerate((high, low)) for name, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))]).collect()
        middle, state, going = {r["feature"]: r["middle"] for r in begun}, {}, set()
        for r in begun:
            n = max(1, r["n0"] + r["n1"])
            state[r["feature"]] = np.array([[r[f"m{k}"] if r[f"m{k}"] is not None else np.nan, r[f"s{k}"] or 0.0, r[f"n{k}"] / n] for k in (0, 1)])
            going.add(r["feature"])
        for _ in range(max_iter):
            if not going:
                break
            for feature, new in _step(frame, {f: state[f] for f in going}).items():
                moved = np.abs(new - state[feature])
                state[feature] = new
                if not (moved > stop).all():
                    going.discard(feature)
    finally:
        frame.unpersist()
    return {f: border(*x.T, middle[f]) for f, x in state.items()}


def _step(frame: DataFrame, state: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """New (mean, variance, prior) of both classes of each feature; deviations are from the means before."""
    old = frame.sparkSession.createDataFrame([(f, *map(float, x.ravel())) for f, x in state.items()], "feature string, m0 double, s0 double, p0 double, m1 double, s1 double, p1 double")
    v = F.col("v")
    weight = lambda k: F.col(f"p{k}") * F.when(F.col(f"s{k}") == 0, 1.0).otherwise(F.exp(-((v - F.col(f"m{k}")) ** 2) / (2 * F.col(f"s{k}"))) / F.sqrt(2 * np.pi * F.col(f"s{k}")))
    share = frame.join(F.broadcast(old), "feature").withColumn("w0", weight(0)).withColumn("w1", weight(1))
    sums = [x for k in (0, 1) for h in [F.try_divide(F.col(f"w{k}"), F.col("w0") + F.col("w1"))] for x in (F.sum(h).alias(f"h{k}"), F.sum(h * v).alias(f"x{k}"), F.sum(h * (v - F.col(f"m{k}")) ** 2).alias(f"q{k}"))]
    out = {}
    for r in share.groupBy("feature").agg(F.count("*").alias("n"), *sums).collect():
        h = [r[f"h{k}"] if r[f"h{k}"] else np.nan for k in (0, 1)]
        out[r["feature"]] = np.array([[(r[f"x{k}"] or 0.0) / h[k], (r[f"q{k}"] or 0.0) / h[k], h[k] / r["n"]] for k in (0, 1)])
    return out


def thresholds(features: DataFrame) -> dict[str, float]:
    """Of each feature the border between its low and its high class."""
    return two_class_limits(features.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in FEATURES])).alias("x")).select("x.feature", "x.v"))


def classes(features: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(ic, kind) of components that are horizontal or vertical eye movements, blinks or discontinuities: intersections of tests, united."""
    over = lambda f: features.filter(F.col(f) >= limits[f]).select("ic")
    same, opposite = features.filter("left * right > 0").select("ic"), features.filter("left * right < 0").select("ic")
    front = features.filter("diff_var > 0").select("ic")
    found = {
        "horizontal": over("sed").intersect(opposite).intersect(over("mev")), "vertical": over("sad").intersect(same).intersect(front).intersect(over("mev")),
        "blink": over("sad").intersect(same).intersect(over("kurtosis")).intersect(front), "discontinuity": over("gdsf").intersect(over("mev")),
    }
    out = None
    for kind, frame in found.items():
        part = frame.select("ic", F.lit(kind).alias("kind"))
        out = part if out is None else out.union(part)
    return out.distinct()


def badness(features: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(ic, badness): by how much features exceed their limits, relative to them, in sum."""
    total = sum((F.greatest(F.lit(0.0), (F.col(f) - limits[f]) / limits[f]) for f in FEATURES), F.lit(0.0))
    return features.select("ic", total.alias("badness"))


def worst(scored: DataFrame, remove: int = 2) -> DataFrame:
    """The components to take out: the worst ones that are bad at all; of equally bad ones the last."""
    return scored.filter("badness > 0").orderBy(F.desc("badness"), F.desc("ic")).limit(remove)
