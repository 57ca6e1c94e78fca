import numpy as np
import pytest
from pyspark.sql import functions as F

from modeloom.functions import filters, wavelets
from modeloom.functions.smvmd import Settings
from modeloom.operators import classifiers, decompose, features, folds, neighbors, segments, selection, signals, stats
from modeloom.plans import experiments
from modeloom.sources import recordings, results
from modeloom.streaming import windows


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i % 2), int(i % 6), int(i % 4), (rng.normal(size=6) + (i % 2) * np.array([2, 1, 0, 0, 0, 0])).tolist()) for i in range(80)]
    return spark.createDataFrame(rows, "row_id long, label int, grp long, fold int, f array<double>").cache()


def brute_votes(rows, k, power):
    out = {}
    for a in rows:
        d = sorted((round(float(np.abs(np.array(a["f"]) - np.array(b["f"])).sum()), 12), b["row_id"], b["label"]) for b in rows if b["fold"] != a["fold"])[:k]
        w = {c: sum((1 / (x[0] ** 2 + 1e-10)) if power else 1 for x in d if x[2] == c) for c in (0, 1)}
        out[a["row_id"]] = 1 if w[1] > w[0] + 1e-12 else 0
    return out


@pytest.mark.parametrize("block", [10_000, 17])
def test_neighbours_in_blocks(matrix, block):
    wanted = brute_votes(matrix.collect(), 3, True)
    found = neighbors.classify(matrix, 3, "cityblock", "squared_inverse", block).collect()
    assert {r["row_id"]: r["predicted"] for r in found} == wanted


def test_split_votes_of_two_go_to_the_less_label(spark):
    rows = spark.createDataFrame([(0, 1, 0, [0.0]), (1, 0, 1, [1.0]), (2, 1, 1, [1.0])], "row_id long, label int, fold int, f array<double>")
    assert {r["row_id"]: r["predicted"] for r in neighbors.classify(rows, 2, "euclidean").collect()}[0] == 0


def test_scaling_leaves_the_tested_fold_out(matrix):
    rows = matrix.collect()
    out = neighbors.standardise(matrix).filter("in_fold = 2").collect()
    train = np.array([r["f"] for r in rows if r["fold"] != 2])
    for r in out[:5]:
        f = np.array(next(x["f"] for x in rows if x["row_id"] == r["row_id"]))
        assert np.allclose(r["f"], (f - train.mean(0)) / train.std(0))


def test_informative_features_come_first(matrix):
    assert selection.rank(matrix, "F", 2)[0] == 0
    assert selection.rank(matrix, "MI", 2)[0] == 0
    with pytest.raises(ValueError):
        selection.rank(matrix, "other")


def brute_experiment(rows, k, keep):
    """Ranked by variance and correlation, scaled, voted: fold by fold on arrays."""
    f, y, fold = np.array([r["f"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
    out = {}
    for i in set(fold.tolist()):
        x, c = f[fold != i], y[fold != i]
        groups = [x[c == v] for v in (0, 1)]
        between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups)
        score, chosen, red = between / (sum(g.var(0) * len(g) for g in groups) / (len(x) - 2)), [], np.abs(np.corrcoef(x.T))
        while len(chosen) < keep:
            chosen.append(max((j for j in range(x.shape[1]) if j not in chosen), key=lambda j: score[j] - (red[j, chosen].mean() if chosen else 0)))
        a, b = (f[:, chosen] - x[:, chosen].mean(0)) / x[:, chosen].std(0), np.flatnonzero(fold != i)
        for r in np.flatnonzero(fold == i):
            near = sorted(b, key=lambda q: (round(float(np.linalg.norm(a[r] - a[q])), 12), q))[:k]
            out[int(r)] = int(y[near].mean() > 0.5)
    return out


def test_experiment_with_selection_and_scaling(matrix):
    rows = sorted(matrix.collect(), key=lambda r: r["row_id"])
    out = experiments.evaluate(matrix, 3, "euclidean", "uniform", keep=2, scale=True).collect()
    assert {r["row_id"]: r["predicted"] for r in out} == brute_experiment(rows, 3, 2)
    assert experiments.report(experiments.evaluate(matrix, 3, "euclidean", "uniform"), "grp")["votes"].first()["n_subjects"] == 6


def test_subject_folds(matrix):
    for f in (folds.grouped(matrix, "grp", 3), folds.stratified_grouped(matrix, "grp", 3), experiments.subject_independent(matrix, "grp", 3)):
        assert f.select("grp", "fold").distinct().count() == 6


def test_arrow_features_equal_sql_features(spark):
    rng = np.random.default_rng(2)
    rows = [(w, i, float(x)) for w in range(5) for i, x in enumerate(rng.normal(size=21))]
    long = spark.createDataFrame(rows, "w int, i int, x double")
    sql = {r["w"]: r for r in features.grouped(long, ["w"], 128.0, 21).collect()}
    arrays = long.groupBy("w").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("values"))
    for r in features.fast(arrays, ["w"], 128.0).collect():
        assert all(np.isclose(r[n], sql[r["w"]][n]) for n in ("std", "var", "rms", "iqr", "assr", "ap", "mfl", "ip", "pcc"))


def test_broken_segments_are_told_apart(spark):
    rows = spark.createDataFrame([(0, [[1.0, 2.0, 3.0, 4.0]]), (1, [[1.0], [1.0, 2.0]])], "seg long, signal array<array<double>>")
    found = {r["seg"]: r for r in decompose.feature_vectors(rows, ["seg"], 128.0, Settings(max_modes=3)).collect()}
    assert found[0]["error"] is None and len(found[0]["f"]) == 9 and found[1]["f"] is None and "ValueError" in found[1]["error"]


def test_end_to_end(spark):
    t = np.arange(2000) / 128
    rows = [(f"s{i}", np.stack([np.sin(2 * np.pi * (5 + i) * t), np.cos(2 * np.pi * (20 + i) * t)]).tolist()) for i in range(2)]
    made = experiments.features(spark.createDataFrame(rows, "subject string, signal array<array<double>>"), ["subject"], 128.0, 5.0, 0.5, Settings())
    out = made.collect()
    assert len(out) == 2 * 5 and all(len(r["f"]) == 18 and r["n_modes"] >= 2 for r in out) and sorted(r["row_id"] for r in out) == list(range(1, 11))


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_ranges(spark, descending):
    rng = np.random.default_rng(4)
    values = rng.permutation(500)
    frame = spark.createDataFrame([(float(v), int(v) % 7) for v in values], "v double, n int")
    found = {r["v"]: r["s"] for r in stats.running(frame, "v", {"s": "n"}, descending, 8).collect()}
    total = 0
    for v in sorted(found, reverse=descending):
        total += int(v) % 7
        assert found[v] == total
    assert stats.running(frame.limit(0), "v", {"s": "n"}).count() == 0


def test_dispatch(spark):
    rows = spark.createDataFrame([(0, [[1.0] * 64])], "seg long, signal array<array<double>>")
    assert signals.preprocess(rows, "b") is rows
    with pytest.raises(ValueError):
        signals.preprocess(rows, "C")
    with pytest.raises(ValueError):
        signals.clean_raw(rows, method="other")


def test_files_of_other_kinds_are_rows_with_errors(spark):
    rows = spark.createDataFrame([("a/x.mat", bytearray(b"")), ("a/y.txt", bytearray(b"1")), ("a/z.zip", bytearray(b"no"))], "path string, content binary")
    assert recordings.load(rows).filter("error IS NOT NULL").count() == 3


def test_cache_is_made_again_for_other_settings(spark, tmp_path):
    folder = str(tmp_path / "cache")
    assert results.read_cache(spark, folder, "a") is None
    results.write_cache(spark.range(3).toDF("x"), folder, "a")
    assert results.read_cache(spark, folder, "a").count() == 3 and results.read_cache(spark, folder, "b") is None


def test_streamed_windows_equal_batch_windows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(s, float(t), float(rng.normal())) for s in range(2) for t in range(60)]
    frame = spark.createDataFrame(rows, "subject long, at double, x double")
    source = str(tmp_path / "in")
    for low in (0, 20, 40):
        frame.filter((F.col("at") >= low) & (F.col("at") < low + 20)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    query = windows.window_features(stream, 15, 7, 1.0).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["subject"], r["w"]): r["std"] for r in spark.table("found").collect()}
    long = segments.long_windows(frame.select("subject", F.col("at").cast("long").alias("t"), "x"), 15, 7, ["subject"])
    wanted = {(r["subject"], r["w"]): r["std"] for r in features.grouped(long, ["subject", "w"], 1.0, 15, False).collect()}
    assert got.keys() == wanted.keys() and all(np.isclose(got[k], wanted[k]) for k in got)


def test_comparison_of_classifiers(matrix):
    found = {r["classifier"]: r["accuracy"] for r in classifiers.compare(matrix, 3, "euclidean", bags=5).collect()}
    assert set(found) == {"knn", "decision_tree", "rbf_svm", "bagged_trees"} and min(found.values()) > 0.6


def test_queries_take_all_features_and_counts(spark, data):
    from modeloom.plans.queries import QUERIES

    assert sorted(r["feat"] for r in QUERIES["mr1_ranking_by_information"](spark, data).collect()) == list(range(64))
    pairs = {(r["a"], r["b"]) for r in QUERIES["mr3_neighbour_redundancy"](spark, data).collect()}
    assert pairs == {(a, b) for b in range(64) for a in range(b)}
    assert sorted(r["n_features"] for r in QUERIES["mr9_accuracy_by_count"](spark, data).collect()) == selection.sweep_counts(64)


def test_shuffled_folds_are_even_and_hang_on_the_seed(spark):
    rows = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"))
    one, other = (folds.shuffled(rows, 7, seed) for seed in (1, 2))
    for label, total in ((0, 4500), (1, 500)):
        sizes = [r["count"] for r in one.filter(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 7 and sum(sizes) == total and max(sizes) - min(sizes) <= 1
    both = one.select("row_id", "fold").join(other.select("row_id", F.col("fold").alias("f")), "row_id")
    assert both.filter("fold = f").count() < 1500
    assert one.exceptAll(folds.shuffled(rows.repartition(3).withColumn("fold", F.lit(9)), 7, 1).select(*one.columns)).count() == 0
    assert folds.shuffled(rows.limit(0), 7).count() == 0 and folds.dealt(rows.limit(0), 7).count() == 0


def test_channels_of_many_recordings_at_once(spark):
    """Recordings of several lengths and rates, an empty and a null one: as if each were filtered alone."""
    rng = np.random.default_rng(8)
    sizes = [(2, 40, 128.0), (3, 40, 128.0), (2, 41, 128.0), (1, 40, 256.0), (1, 1, 128.0)]
    rows = [(i, fs, rng.normal(size=(c, n)).tolist()) for i, (c, n, fs) in enumerate(sizes)] + [(5, 128.0, []), (6, 128.0, None), (7, 128.0, [[], []])]
    recordings = spark.createDataFrame(rows, "id int, fs double, signal array<array<double>>")
    found = {r["id"]: r["signal"] for r in signals.bandpass(recordings, 1.0, 30.0, fs="fs").collect()}
    for i, fs, x in rows[:5]:
        assert np.allclose(found[i], filters.bandpass(np.array(x), fs, 1.0, 30.0), atol=1e-12)
    assert found[5] == [] and found[6] == [] and found[7] == [[], []]
    calm = {r["id"]: r["signal"] for r in signals.denoise(recordings, fs="fs").collect()}
    for i, _, x in rows[:5]:
        assert np.allclose(calm[i], [wavelets.denoise(np.array(c)) for c in x], atol=1e-12)


def clustered(spark, n=900, folds=5, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 6)) * 30
    rows = [(i, int(i % 3), int(i % folds), (centres[i % 12] + rng.normal(size=6)).tolist()) for i in range(n)]
    rows += [(n + i, 0, int(i % folds), rows[i][3]) for i in range(20)]
    return spark.createDataFrame(rows, "row_id long, label int, fold int, f array<double>").repartition(4).cache()


def brute_neighbours(rows, k, metric):
    x, fold, ids = np.array([r["f"] for r in rows]), np.array([r["fold"] for r in rows]), np.array([r["row_id"] for r in rows])
    d = np.round(neighbors._distances(x, x, metric), 12)
    out = {}
    for i in range(len(rows)):
        at = np.flatnonzero(fold != fold[i])
        out[ids[i]] = [(ids[j], d[i, j]) for j in sorted(at, key=lambda j: (d[i, j], ids[j]))[:k]]
    return out


@pytest.mark.parametrize("metric, k, block, pivots, small", [("euclidean", 3, 10_000, 256, 0), ("cityblock", 7, 50, 256, 0), ("chebyshev", 1, 10_000, 5, 0), ("cosine", 4, 100, 40, 0), ("euclidean", 400, 10_000, 256, 0), ("cosine", 4, 10_000, 40, 10_000)])
def test_pruned_neighbours_are_all_neighbours(spark, metric, k, block, pivots, small):
    rows = clustered(spark)
    found = {}
    for r in neighbors.neighbours(rows, k, metric, block, pivots=pivots, small=small).collect():
        found.setdefault(r["test_id"], []).append((r["r"], r["train_id"], r["d"]))
    wanted = brute_neighbours(rows.collect(), k, metric)
    assert {i: [(t, pytest.approx(d, abs=1e-11)) for _, t, d in sorted(x)] for i, x in found.items()} == wanted


def test_few_pairs_of_clustered_rows_are_compared(spark):
    rows = clustered(spark)
    assert neighbors.compared(rows, 3, small=0) < 0.2 * 920 * 920
    assert neighbors.compared(rows, 3) == 920 * 920
    assert neighbors.compared(rows.limit(0), 3, small=0) == 0 == neighbors.compared(rows.limit(0), 3)


def test_folds_in_one_plan_are_folds_apart(spark):
    rows = clustered(spark, 200)
    found = experiments.evaluate(rows, 3, "euclidean", "uniform", keep=3, scale=True).select("row_id", "predicted").collect()
    wanted = {}
    for f in range(5):
        chosen = selection.rank(rows.filter(F.col("fold") != f), "F", 3)
        own = neighbors.standardise(rows).filter(F.col("in_fold") == f).drop("in_fold")
        two = selection.project(own, chosen).withColumn("fold", F.when(F.col("fold") == f, f).otherwise(-1))
        wanted |= {r["row_id"]: r["predicted"] for r in neighbors.classify(two, 3, "euclidean").filter(F.col("fold") == f).collect()}
    assert {r["row_id"]: r["predicted"] for r in found} == wanted and len(found) == 220


@pytest.mark.parametrize("small", [0, 1000])
def test_vectors_without_direction_have_no_cosine(spark, small):
    rows = spark.createDataFrame([(i, 0, i % 2, [float(i % 3), 0.0 if i % 3 == 0 else 1.0 + i]) for i in range(30)], "row_id long, label int, fold int, f array<double>")
    found = {(r["test_id"], r["train_id"]) for r in neighbors.neighbours(rows, 2, "cosine", small=small).collect()}
    assert all(a % 3 and b % 3 for a, b in found) and len(found) == 40


def test_pruned_tasks_are_tasks_in_full(spark):
    rows = clustered(spark, 240)
    each = neighbors.standardise(rows)
    of = lambda small, apart: {(r["task"], r["test_id"], r["r"]): (r["train_id"], r["d"]) for r in neighbors.neighbours(each, 3, "euclidean", by="in_fold", apart=apart, small=small).collect()}
    for apart in (True, False):
        assert of(0, apart) == of(10_000, apart)


def test_a_folder_of_part_files_is_one_table(spark, tmp_path):
    from modeloom.plans.chain_queries import ORACLES, QUERIES
    from tests.oracle import check

    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        spark.range(20).repartition(3 if name < "n" else 1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert check(spark, str(tmp_path), QUERIES["src1_file_catalog"], ORACLES["src1_file_catalog"]) == 1
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/a.parquet/b.parquet")
    assert sorted(r["path"] for r in recordings.tables(spark, f"file://{tmp_path}/a.parquet/").collect()) == ["b.parquet"]


def scattered(spark, n=3000, p=24):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, p))
    return spark.createDataFrame([(i, int(i % 2), int(i % 5), r.tolist()) for i, r in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "row_id long, label int, fold int, f array<double>")


@pytest.mark.parametrize("metric", ["cityblock", "cosine"])
def test_rows_without_clusters_are_sent_to_few_groups(spark, metric):
    rows = scattered(spark).cache()
    tests, trains, *_ = neighbors._meetings(rows, 2, metric, 1000, None, False, 256, 0)
    assert tests.count() + trains.count() < 3000 * 40
    found = {}
    for r in neighbors.neighbours(rows, 2, metric, 1000, small=0).filter("test_id < 200").collect():
        found.setdefault(r["test_id"], []).append((r["r"], r["train_id"]))
    x, fold = np.array([r["f"] for r in rows.orderBy("row_id").collect()]), np.arange(3000) % 5
    d = np.round(neighbors._distances(x[:200], x, metric), 12)
    d[fold[:200, None] == fold] = np.inf
    assert {i: [t for _, t in sorted(v)] for i, v in found.items()} == {i: np.argsort(r, kind="stable")[:2].tolist() for i, r in enumerate(d)}


@pytest.mark.parametrize("metric", ["cityblock", "euclidean", "chebyshev", "cosine"])
@pytest.mark.parametrize("made", ["plain", "ties", "far", "huge", "tiny"])
def test_nearest_of_rough_distances_are_the_nearest(metric, made):
    from modeloom.functions.nearest import Nearest

    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6))
    x = {"plain": x, "ties": np.round(x), "far": x + 1e4, "huge": x * 1e20, "tiny": x * 1e-20}[made]
    fold, ids = np.arange(900) % 4, rng.permutation(900)
    near = Nearest(x[:100], fold[:100], 3, metric, [2, 6])
    for low in (0, 500):
        near.meet(x[low : low + 500], ids[low : low + 500], ids[low : low + 500] % 2, fold[low : low + 500])
    for c, n in enumerate((2, 6)):
        with np.errstate(all="ignore"):
            d = np.round(neighbors._distances(x[:100, :n], x[:, :n], metric), 12)
        d[(fold[:100, None] == fold) | np.isnan(d)] = np.inf
        wanted = [[ids[j] if np.isfinite(r[j]) else np.iinfo(np.int64).max for j in np.lexsort((ids, r))[:3]] for r in d]
        assert near.ids[c].tolist() == np.array(wanted).tolist()


def test_a_sweep_sends_rows_once_for_all_counts(spark, monkeypatch):
    rows, sent = scattered(spark, 400, 6).cache(), []
    monkeypatch.setattr(neighbors, "_meet", lambda tests, trains, *rest, own=neighbors._meet: sent.append((tests.count(), trains.count() / rows.sparkSession.sparkContext.defaultParallelism)) or own(tests, trains, *rest))
    order = [3, 0, 5, 1, 2, 4]
    found = {r["n_features"]: r["cv_accuracy"] for r in experiments.sweep(rows, order, [1, 2, 6], 2, "cityblock", "uniform").collect()}
    assert len(sent) == 1 and sent[0][0] == 400 and sent[0][1] <= 400 * neighbors.GROUPS
    for n in (1, 2, 6):
        told = neighbors.classify(selection.project(rows, order[:n]), 2, "cityblock").groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("a"))
        assert found[n] == pytest.approx(told.agg(F.avg("a")).first()[0])


def test_silhouette_of_close_rows_far_from_the_origin(spark):
    rng = np.random.default_rng(6)
    x, y = 1e6 + np.repeat(rng.normal(size=(30, 3)), 2, axis=0) + 1e-7 * rng.normal(size=(60, 3)), np.arange(60) % 3
    found = {r["row_id"]: r["s"] for r in neighbors.silhouette(spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))], "row_id long, label int, f array<double>"), "label", block=17).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(60):
        a, b = d[i, y == y[i]].sum() / 19, min(d[i, y == c].mean() for c in range(3) if c != y[i])
        assert found[i] == pytest.approx((b - a) / max(a, b), abs=1e-7)
