"""Nearest neighbours between test and training rows: distances, weights and votes.

Rows are (row_id, label, f, fold). Every test row looks for its neighbours in the other folds. Some rows are pivots, and a
row belongs to the cell of its nearest one. From the rows nearest to each pivot follows how far the k-th neighbour of any
row of a cell can be at most; by the triangle inequality a training row goes only to cells that it can be a neighbour in.
Where cells would save less than half of the pairs, or send a row to many of them, every block of tests meets every block of
training rows instead. Blocks meet in tasks of their own, which hold a block of tests and pass over the training rows, and
give each test's nearest k there, which then meet in a top k: no pair of rows ever becomes a row, and only pivots and a few
distances of each cell pass the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.functions.nearest import METRICS, Nearest, distances as _distances, sums_of_distances

#: Tests that a task holds at most; training rows that pass it.
BLOCK, PASSING = 20_000, 1 << 17
#: Pivots of a task, of which a row of n is one in about sqrt(n) up to this many.
PIVOTS = 256
#: Tasks of no more rows are compared in full: their cells would cost more than they save. So are those of which cells would
#: leave more than a share of the pairs, or in which a row would go to more cells than so many on average.
SMALL, SHARE, CELLS = 20_000, 0.5, 16
#: Groups of blocks that each core gets at least, and the fewest training rows that pass a block then.
GROUPS, FEWEST = 3, 4096


def distance(a: Column, b: Column, metric: str) -> Column:
    """Between two arrays."""
    total = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, v: s + v)
    kind = METRICS[metric]
    if kind == "cityblock":
        return total(lambda x, y: F.abs(x - y))
    if kind == "euclidean":
        return F.sqrt(total(lambda x, y: (x - y) * (x - y)))
    if kind == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return 1 - total(lambda x, y: x * y) / (norm(a) * norm(b))


def weight(d: Column, kind: str) -> Column:
    if kind in ("distance", "inverse"):
        return F.when(d > 0, 1 / d).otherwise(F.lit(float("inf")))
    if kind == "squared_inverse":
        return 1 / (d * d + 1e-10)
    return F.lit(1.0)


def _in_full(tests: DataFrame, trains: DataFrame, most_tests: int, most_trains: int, tasks: int, block: int, passing: int = PASSING) -> tuple[DataFrame, DataFrame, int]:
    """Every block of tests with every block of training rows of its task, and how many groups these are; a row goes to as many groups as there are blocks of the others."""
    ours, theirs = max(1, -(-most_tests // block)), max(1, -(-most_trains // passing))
    wanted = -(-GROUPS * tests.sparkSession.sparkContext.defaultParallelism // (max(1, tasks) * ours))
    theirs = max(theirs, min(wanted, -(-most_trains // FEWEST)))
    # Aliases make the two sides different tables to Spark.
    side = lambda frame, a, b: frame.select(*[F.col(c).alias(c) for c in frame.columns if c not in ("tested", "cell", "ours", "theirs")], F.lit(0).alias("cell"), a.alias("ours"), b.alias("theirs"))
    at = lambda seed, n: F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return side(tests, at(1, ours), every(theirs)), side(trains, every(ours), at(2, theirs)), max(1, tasks) * ours * theirs


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(array), -1)


def _meet(tests: DataFrame, trains: DataFrame, begin: Callable[[pa.Table], object], schema: str, groups: int) -> DataFrame:
    """What groups of tests and training rows (MEET, row_id, ..) give. `begin` makes of a group's tests what gets its training
    rows, some at a time, by `meet`, and has `found` in the end; so a task holds no more than one block of tests."""
    columns = [*MEET, *[c for c in tests.columns if c not in MEET]]
    both = tests.select(*columns, F.lit(False).alias("passing")).unionByName(trains.select(*columns, F.lit(True).alias("passing")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, meeting = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*MEET, "passing")], axis=1)
            ends = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for low, high in zip(ends[:-1], ends[1:], strict=True):
                part, group = batch.slice(low, high - low), tuple(keys[low, :-1])
                if group != at:
                    if meeting is not None:
                        yield from meeting.found()
                    at, held, meeting = group, [], None
                if not keys[low, -1]:
                    held.append(part)
                elif held:
                    if meeting is None:
                        meeting, held = begin(pa.Table.from_batches(held)), [True]
                    meeting.meet(part)
        if meeting is not None:
            yield from meeting.found()

    parts = max(int(tests.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * groups, 4000))
    return both.repartition(parts, *MEET).sortWithinPartitions(*MEET, "passing").mapInArrow(run, schema)


def _groups_of(tests: DataFrame, trains: DataFrame) -> DataFrame:
    tests, trains = (side.groupBy(*MEET).agg(F.count("*").alias(n)) for side, n in zip((tests, trains), "ab", strict=True))
    return tests.join(trains, list(MEET))


def _points(column: pd.Series, metric: str) -> np.ndarray:
    """Rows in a space whose distances, those of `_bounding`, obey the triangle inequality and order neighbours as the metric does."""
    x = np.stack(column.to_numpy()).astype(float)
    if METRICS[metric] == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(length > 0, length, 1)
    return x


def _bounding(metric: str) -> str:
    return "euclidean" if METRICS[metric] == "cosine" else METRICS[metric]


@dataclass
class Cells:
    """Of a task: its pivots; how far a training row may be from a pivot to go to its cell; blocks of tests and of training rows."""

    pivots: np.ndarray
    reach: np.ndarray
    tests: np.ndarray
    trains: np.ndarray


def _limits(pivots: np.ndarray, farthest: np.ndarray, near: pd.DataFrame, k: int, metric: str, apart: bool) -> np.ndarray:
    """Of each cell how far its pivot can be from a neighbour of its tests: twice the farthest test's distance, plus what the
    k-th row is away from the pivot at most, the k-th outside of any fold where tests and training rows aren't `apart`; `near`
    has some of each cell's rows (cell, fold, d)."""
    between = _distances(pivots, pivots, _bounding(metric))
    away = between[:, near["cell"].to_numpy(int)] + near["d"].to_numpy(float)
    order, folds, out = np.argsort(away, axis=1, kind="stable"), near["fold"].to_numpy(), np.full(len(pivots), np.inf)
    for i in np.flatnonzero(farthest >= 0):
        own = folds[order[i]]
        seen: dict = {}
        top = 0
        for j, f in enumerate(own):
            seen[f] = seen.get(f, 0) + 1
            top = max(top, seen[f])
            if j + 1 - (0 if apart else top) >= k:
                out[i] = 2 * farthest[i] + away[i, order[i, j]]
                break
    # Distances that round to the same twelve decimals count as equal; those between unit vectors are square roots of that.
    return out * (1 + 1e-9) + (1e-5 if METRICS[metric] == "cosine" else 1e-9)


def _meetings(rows: DataFrame, k: int, metric: str, block: int, by: str | None, apart: bool, pivots: int, small: int) -> tuple[DataFrame, DataFrame, int]:
    """Tests and training rows, each with the keys of the groups in which they meet, and about how many groups there are."""
    task = F.col(by).cast("long") if by else F.lit(0).cast("long")
    own = rows.select("row_id", "label", "fold", "f", task.alias("task"), ((F.col("fold") == F.col(by)) if apart else F.lit(True)).alias("tested"))
    trains = own.filter("NOT tested") if apart else own
    spark = rows.sparkSession
    sizes = own.groupBy("task").agg(F.count("*").alias("n"), F.count_if("tested").alias("tests")).collect()
    counts, tested = {r["task"]: r["n"] for r in sizes}, {r["task"]: r["tests"] for r in sizes}
    passing = {t: n - tested[t] * apart for t, n in counts.items()}
    in_full = lambda: _in_full(own.filter("tested"), trains, max(tested.values(), default=0), max(passing.values(), default=0), len(counts), block)
    if max(counts.values(), default=0) <= small:
        return in_full()
    wanted = {t: min(pivots, math.isqrt(n) + 1) for t, n in counts.items()}
    chance = {t: min(1.0, wanted[t] / counts[t]) for t in counts}
    drawn = F.pmod(F.xxhash64("row_id", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    table = spark.createDataFrame([(t, float(c)) for t, c in chance.items()], "task long, chance double")
    found = own.join(F.broadcast(table), "task").filter(drawn < F.col("chance")).select("task", "f").collect()
    places = {t: _points(pd.Series([r["f"] for r in found if r["task"] == t]), metric) if any(r["task"] == t for r in found) else None for t in counts}
    width = next((len(p[0]) for p in places.values() if p is not None), 0)
    places = {t: np.zeros((1, width)) if p is None else p for t, p in places.items()}
    shared, kind = spark.sparkContext.broadcast(places), _bounding(metric)

    def each_task(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
        for frame in frames:
            for t, part in frame.groupby("task", sort=False):
                for low in range(0, len(part), 4096):
                    some = part.iloc[low : low + 4096]
                    at = shared.value[t]
                    yield t, some, _distances(_points(some["f"], metric), at if at.shape[1] else np.zeros((1, len(some["f"].iloc[0]))), kind)

    def celled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, some, d in each_task(frames):
            # A vector without a direction has no cosine, so nothing follows from where it is.
            lost = ~_points(some["f"], metric).any(axis=1) if METRICS[metric] == "cosine" else False
            yield some.drop(columns=["f", "label"]).assign(cell=d.argmin(axis=1), d=np.where(lost, np.inf, d.min(axis=1)))

    id_kind, fold_kind = own.schema["row_id"].dataType.simpleString(), own.schema["fold"].dataType.simpleString()
    cells = own.mapInPandas(celled, f"row_id {id_kind}, fold {fold_kind}, task long, tested boolean, cell int, d double")
    extent = cells.filter("tested").groupBy("task", "cell").agg(F.max("d").alias("d"), F.count("*").alias("n")).toPandas()
    first = Window.partitionBy("task", "cell", "fold").orderBy("d")
    second = Window.partitionBy("task", "cell").orderBy("d")
    near = (cells.filter("NOT tested") if apart else cells).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    near = near.withColumn("r", F.row_number().over(second)).filter(F.col("r") <= 2 * k).select("task", "cell", "fold", "d").toPandas()
    plan: dict[int, Cells] = {}
    held: dict[int, np.ndarray] = {}
    for t, at in places.items():
        mine = extent[extent["task"] == t]
        farthest, tests = np.full(len(at), -1.0), np.zeros(len(at), int)
        farthest[mine["cell"]], tests[mine["cell"]] = mine["d"], -(-mine["n"].to_numpy() // block)
        held[t] = np.zeros(len(at))
        held[t][mine["cell"]] = mine["n"]
        reach = np.where(farthest >= 0, _limits(at, farthest, near[near["task"] == t], k, metric, apart), -1.0)
        plan[t] = Cells(at, reach, tests, np.ones(len(at), int))
    reaching = spark.sparkContext.broadcast({t: c.reach for t, c in plan.items()})

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for t, _, d in each_task(frames):
            total[t] = total.get(t, 0) + (d <= reaching.value[t]).sum(axis=0)
        for t, n in total.items():
            yield pd.DataFrame({"task": t, "cell": np.flatnonzero(n), "n": n[n > 0]})

    pairs = sent = 0
    for r in trains.mapInPandas(counted, "task long, cell int, n long").groupBy("task", "cell").agg(F.sum("n").alias("n")).collect():
        plan[r["task"]].trains[r["cell"]] = -(-r["n"] // PASSING)
        pairs += r["n"] * held[r["task"]][r["cell"]]
        sent += r["n"]
    if pairs > SHARE * sum(tested[t] * passing[t] for t in counts) or sent > CELLS * sum(passing.values()):
        return in_full()
    dealt = spark.sparkContext.broadcast(plan)

    def asking(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, some, d in each_task(frames):
            c, cell = dealt.value[t], d.argmin(axis=1)
            times = c.trains[cell]
            out = some.iloc[np.repeat(np.arange(len(some)), times)]
            yield out.assign(cell=np.repeat(cell, times), ours=_hashes(out["row_id"]) % np.maximum(1, np.repeat(c.tests[cell], times)), theirs=np.concatenate([np.zeros(0, int), *map(np.arange, times)])).drop(columns="tested")

    def answering(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t, some, d in each_task(frames):
            c = dealt.value[t]
            at, cell = np.nonzero(d <= c.reach)
            times = c.tests[cell]
            every, row, cell = np.concatenate([np.zeros(0, int), *map(np.arange, times)]), np.repeat(at, times), np.repeat(cell, times)
            for low in range(0, len(row), 4096):
                part = slice(low, low + 4096)
                out = some.iloc[row[part]]
                # The tests' hash with another turn, so that blocks of tests and of training rows are cut alike nowhere.
                yield out.assign(cell=cell[part], ours=every[part], theirs=_hashes(out["row_id"]) // 7 % c.trains[cell[part]]).drop(columns="tested")

    schema = f"row_id {id_kind}, label {own.schema['label'].dataType.simpleString()}, fold {fold_kind}, f array<double>, task long, cell int, ours long, theirs long"
    doubled = lambda x: x.withColumn("f", F.col("f").cast("array<double>"))
    return doubled(own.filter("tested")).mapInPandas(asking, schema), doubled(trains).mapInPandas(answering, schema), sum(int((c.tests * c.trains).sum()) for c in plan.values())


def _hashes(ids: pd.Series) -> np.ndarray:
    return pd.util.hash_array(ids.to_numpy()).astype(np.int64) & 0x7FFFFFFFFFFFFFFF


MEET = ("task", "cell", "ours", "theirs")


def compared(rows: DataFrame, k: int, metric: str = "euclidean", block: int = BLOCK, by: str | None = None, apart: bool = True, pivots: int = PIVOTS, small: int = SMALL) -> int:
    """How many pairs of rows are compared."""
    tests, trains, _ = _meetings(rows, k, metric, block, by, apart and by is not None, pivots, small)
    return _groups_of(tests, trains).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0


FOUND = "test_id long, train_id long, train_label int, d double, task long, r int"
_FOUND = pa.schema([("test_id", pa.int64()), ("train_id", pa.int64()), ("train_label", pa.int32()), ("d", pa.float64()), ("task", pa.int64()), ("r", pa.int32())])


class _Neighbours:
    """The nearest training rows of a block of tests; by the first features, where there are `counts`, which are the tasks then."""

    def __init__(self, tests: pa.Table, k: int, metric: str, counts: Sequence[int] | None):
        x = _matrix(tests["f"])
        self.tests, self.counts = tests, counts
        self.near = Nearest(x, tests["fold"].to_numpy(), k, metric, counts)

    def meet(self, part: pa.RecordBatch) -> None:
        self.near.meet(_matrix(part.column("f")), *(part.column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "label", "fold")))

    def found(self) -> Iterator[pa.RecordBatch]:
        ids, tasks = self.tests["row_id"].to_numpy(), self.tests["task"].to_numpy()
        for c in range(len(self.near.counts)):
            for low in range(0, len(ids), 4096):
                d = self.near.d[c, low : low + 4096]
                i, j = np.nonzero(np.isfinite(d))
                at = low + i
                task = np.full(len(i), self.counts[c]) if self.counts else tasks[at]
                columns = (ids[at], self.near.ids[c, at, j], self.near.labels[c, at, j], d[i, j], task, j + 1)
                yield pa.RecordBatch.from_arrays([pa.array(x, from_pandas=True).cast(f.type) for x, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def neighbours(rows: DataFrame, k: int, metric: str = "euclidean", block: int = BLOCK, by: str | None = None, apart: bool = True, pivots: int = PIVOTS, small: int = SMALL) -> DataFrame:
    """(test_id, train_id, train_label, d, r): of each row the k nearest of other folds; of equal ones the least id.

    With a whole number `by` a row may be there once for each, with features of its own there, and meets rows with the same
    `by` only; the result has it as `task`. It's the tested fold if they are `apart`: then rows of that fold only are tested."""
    tests, trains, groups = _meetings(rows, k, metric, block, by, apart and by is not None, pivots, small)
    found = _meet(tests, trains, lambda held: _Neighbours(held, k, metric, None), FOUND, groups).drop("r")
    order = Window.partitionBy("task", "test_id").orderBy("d", "train_id")
    ranked = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    return ranked if by else ranked.drop("task")


def neighbours_by_count(rows: DataFrame, counts: Sequence[int], k: int, metric: str = "euclidean", block: int = BLOCK) -> DataFrame:
    """(task, test_id, train_id, train_label, d, r) as `neighbours` gives, by the first n features of a row for each n of
    `counts`, which is the task. Distances by more features go on from those by fewer; a row is sent once for all counts."""
    own = rows.select("row_id", "label", "fold", F.col("f").cast("array<double>").alias("f"), F.lit(0).cast("long").alias("task"))
    n, counts = own.count(), sorted(set(counts))
    if not n:
        return rows.sparkSession.createDataFrame([], FOUND)
    # All training rows pass each block, so a task tells the nearest of all and nothing has to be ranked over tasks.
    block = max(1, min(block, -(-n // (GROUPS * rows.sparkSession.sparkContext.defaultParallelism))))
    tests, trains, groups = _in_full(own, own, n, 1, 1, block)
    return _meet(tests, trains, lambda held: _Neighbours(held, k, metric, counts), FOUND, groups)


def vote(near: DataFrame, weights: str = "uniform", by: Sequence[str] = ()) -> DataFrame:
    """(by, test_id, predicted): the class of the greatest weight, of equal ones the least."""
    own = [*by, "test_id"]
    w = near.withColumn("w", weight(F.col("d"), weights))
    if weights in ("distance", "inverse"):
        exact = Window.partitionBy(*own)
        # With 1 / d, neighbours at distance 0 outvote all others and count alike.
        w = w.withColumn("w", F.when(F.max("w").over(exact) == float("inf"), F.when(F.col("w") == float("inf"), 1.0).otherwise(0.0)).otherwise(F.col("w")))
    totals = w.groupBy(*own, "train_label").agg(F.sum("w").alias("w"))
    return totals.groupBy(*own).agg(F.max_by("train_label", F.struct(F.round("w", 9), -F.col("train_label"))).alias("predicted"))


def classify(rows: DataFrame, k: int, metric: str = "euclidean", weights: str = "uniform", block: int = BLOCK, by: str | None = None) -> DataFrame:
    """`rows` (without f) with the prediction that rows of other folds make; with `by`, of a row where it is tested."""
    voted = vote(neighbours(rows, k, metric, block, by), weights)
    tested = rows.filter(F.col("fold") == F.col(by)) if by else rows
    return tested.drop("f").join(voted.withColumnRenamed("test_id", "row_id"), "row_id")


def standardise(rows: DataFrame, by_fold: bool = True, column: str = "f") -> DataFrame:
    """Rows once for each fold as (row_id, label, fold, in_fold, f), scaled by mean and deviation of that fold's training rows;
    without `by_fold` scaled by those of all rows."""
    long = rows.select("row_id", "fold", F.posexplode(column).alias("feat", "v"))
    if not by_fold:
        stats = long.groupBy("feat").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        packed = stats.agg(F.sort_array(F.collect_list(F.struct("feat", "m", "s"))).alias("stats"))
        scaled = F.zip_with(column, "stats", lambda v, t: (v - t["m"]) / F.when(t["s"] > 0, t["s"]).otherwise(1.0))
        return rows.join(F.broadcast(packed)).withColumn(column, scaled).drop("stats")
    sums = long.groupBy("fold", "feat").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    every = sums.groupBy("feat").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    left = sums.join(every, "feat").select("fold", "feat", (F.col("tn") - F.col("n")).alias("n"), (F.col("ts") - F.col("s")).alias("s"), (F.col("tq") - F.col("q")).alias("q"))
    mean = F.col("s") / F.col("n")
    stats = left.select("fold", "feat", mean.alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("d"))
    packed = stats.groupBy(F.col("fold").alias("in_fold")).agg(F.sort_array(F.collect_list(F.struct("feat", "m", "d"))).alias("stats"))
    scaled = F.zip_with(column, "stats", lambda v, t: (v - t["m"]) / F.when(t["d"] > 1e-12, t["d"]).otherwise(1.0))
    return rows.join(F.broadcast(packed)).withColumn(column, scaled).drop("stats")


class _Sums:
    """Of a block of rows the sums of distances to the rows of each class."""

    def __init__(self, tests: pa.Table):
        x = _matrix(tests["f"])
        self.tests, self.centre, self.sums = tests, x.mean(axis=0), {}
        self.x = x - self.centre

    def meet(self, part: pa.RecordBatch) -> None:
        own = part.column("own").dictionary_encode()
        codes = own.indices.to_numpy(zero_copy_only=False)
        known = np.isfinite(codes)
        y, names = _matrix(part.column("f"))[known] - self.centre, own.dictionary.to_pylist()
        for low in range(0, len(y), 4096):
            classes = codes[known][low : low + 4096].astype(int)
            sums = sums_of_distances(self.x, y[low : low + 4096], classes, len(names))
            for c in np.unique(classes):
                self.sums[names[c]] = self.sums.get(names[c], 0) + sums[:, c]

    def found(self) -> Iterator[pa.RecordBatch]:
        for cls, d in self.sums.items():
            for low in range(0, len(d), 4096):
                part = self.tests.slice(low, 4096)
                columns = [part["row_id"].combine_chunks(), part["own"].combine_chunks(), pa.array([cls] * len(part), pa.string()), pa.array(d[low : low + 4096])]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "own", "cls", "d"])


def silhouette(rows: DataFrame, group: str, column: str = "f", block: int = BLOCK) -> DataFrame:
    """(row_id, s) by Euclidean distances between all rows. Blocks give each row's sum of distances to each class."""
    cells = rows.select("row_id", F.col(group).cast("string").alias("own"), F.col(column).alias("f"))

    held = cells.select("row_id", "own", F.col("f").cast("array<double>").alias("f"), F.lit(0).cast("long").alias("task"))
    n = held.count()
    tests, trains, groups = _in_full(held, held, n, n, 1, block)
    found = _meet(tests, trains, _Sums, f"row_id {cells.schema['row_id'].dataType.simpleString()}, own string, cls string, d double", groups)
    total = found.groupBy("row_id", "own", "cls").agg(F.sum("d").alias("d")).join(cells.groupBy(F.col("own").alias("cls")).agg(F.count("*").alias("n")), "cls")
    same = F.col("own") == F.col("cls")
    each = total.groupBy("row_id").agg(F.max(F.when(same, F.col("n"))).alias("n"), F.max(F.when(same, F.col("d"))).alias("inner"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("b"))
    each = each.withColumn("a", F.col("inner") / F.greatest(F.col("n") - 1, F.lit(1)))
    return each.select("row_id", F.when((F.col("n") > 1) & F.col("b").isNotNull(), (F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-300))).otherwise(0.0).alias("s"))
