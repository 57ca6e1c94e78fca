"""The data source and the Spark ML estimators."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull

from modeloom.operators import ml, neighbors, selection
from modeloom.plans.source_queries import edf_bytes
from modeloom.sources import datasource, matfile


def edf_of(x, per):
    """x cut into records of `per` samples."""
    whole = edf_bytes(x, 128.0)
    n, records = len(x), x.shape[1] // per
    body = np.frombuffer(whole, "<i2", offset=256 * (n + 1)).reshape(n, records, per).transpose(1, 0, 2)
    head = bytearray(whole[: 256 * (n + 1)])
    head[236:252] = str(records).ljust(8).encode() + f"{per / 128}"[:8].ljust(8).encode()
    at = 256 + 216 * n
    head[at : at + 8 * n] = str(per).ljust(8).encode() * n
    return bytes(head) + body.astype("<i2").tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, root = np.random.default_rng(1), tmp_path_factory.mktemp("recordings")
    truth = {}
    for a in range(3):
        with zipfile.ZipFile(root / f"ADHD_part{a}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(5):
                x = rng.normal(size=(4, 50 + m))
                z.writestr(f"ADHD_part{a}/v{a}{m}p.mat", matfile.write({f"v{a}{m}p": x}))
                truth[f"v{a}{m}p"] = x
            z.writestr("notes.txt", "none")
    x = rng.normal(size=(3, 640))
    (root / "long.edf").write_bytes(edf_of(x, 64))
    truth["long"] = x
    pd.DataFrame(rng.normal(size=(20, 2)), columns=["a", "b"]).to_csv(root / "s.csv", index=False)
    (root / "broken.zip").write_bytes(b"PK no archive")
    (root / "short.mat").write_bytes(b"short")
    return str(root), truth


def test_all_files_are_read(spark, folder):
    root, truth = folder
    datasource.register(spark)
    rows = spark.read.format("recordings").option("width", 4).load(root).collect()
    good = {r["subject"]: r for r in rows if r["error"] is None}
    assert set(good) == {*truth, "s"} and {r["subject"] for r in rows if r["error"]} == {"broken", "short"}
    assert all(np.allclose(good[s]["signal"], x, atol=1e-4) for s, x in truth.items())
    assert good["v03p"]["member"] == "ADHD_part0/v03p.mat" and (good["v03p"]["n_channels"], good["v03p"]["n_samples"]) == (4, 53)


def test_partitions_are_members_and_ranges(folder):
    root, truth = folder
    pieces = datasource.RecordingReader({"path": root, "partitionBytes": "3000", "recordsTogether": "3"}).partitions()
    assert max(len(p.members) for p in pieces if p.members) < 5 and sum(len(p.members) for p in pieces if p.members) == 15
    assert [(p.first, p.count) for p in pieces if p.path.endswith("edf")] == [(0, 3), (3, 3), (6, 3), (9, 1)]


def test_conditions_leave_partitions_out(spark, folder):
    root, truth = folder
    datasource.register(spark)
    source = spark.read.format("recordings").option("recordsTogether", 4).load(root)
    some = source.filter("subject IN ('v11p', 'v20p')")
    assert sorted(r["subject"] for r in some.collect()) == ["v11p", "v20p"] and some.rdd.getNumPartitions() == 2
    late = source.filter("subject = 'long' AND first_record >= 4").orderBy("first_record")
    found = late.collect()
    assert [r["first_record"] for r in found] == [4, 8] and np.allclose(np.concatenate([np.array(r["signal"]) for r in found], axis=1), truth["long"][:, 256:], atol=1e-4)
    assert source.filter("subject = 'nobody'").count() == 0
    assert source.filter("subject = 'v00p' AND n_samples > 1000").count() == 0
    reader = datasource.RecordingReader({"path": root})
    asked = [EqualTo(("subject",), "v00p"), IsNotNull(("subject",)), GreaterThanOrEqual(("first_record",), 3), In(("member",), ("x",))]
    assert list(reader.pushFilters(asked)) == [asked[1], asked[2]], "without ranges a record's number is Spark's to judge"


def test_archives_are_not_read_whole(folder, monkeypatch):
    """Of a member at the end of an archive, less than half of the archive is read."""
    root, _ = folder
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for m in range(40):
            z.writestr(f"v{m}p.mat", matfile.write({f"v{m}p": np.random.default_rng(m).normal(size=(4, 500))}))
    path = f"{root}/../large.zip"
    with open(path, "wb") as f:
        f.write(out.getvalue())
    reader = datasource.RecordingReader({"path": path})
    reader.conditions = [EqualTo(("subject",), "v39p")]
    took = []

    class Counting(io.BytesIO):
        def read(self, *a):
            data = super().read(*a)
            took.append(len(data))
            return data

    class Store:
        def get_file_info(self, p):
            from pyarrow import fs

            return fs.LocalFileSystem().get_file_info(p)

        def open_input_file(self, p):
            return Counting(out.getvalue())

    monkeypatch.setattr(datasource, "opened", lambda p: (Store(), p))
    pieces = reader.partitions()
    assert [p.members for p in pieces] == [["v39p.mat"]]
    assert next(iter(reader.read(pieces[0]))).num_rows == 1 and sum(took) < len(out.getvalue()) / 4


def samples(spark, n=150, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    f = rng.normal(size=(n, 6)) + np.outer(y, [3, 0, 2, 0, 0, 0])
    return spark.createDataFrame([(i, float(b), a.tolist()) for i, (a, b) in enumerate(zip(f, y, strict=True))], "id long, label double, features array<double>").repartition(3)


def test_pipeline_round_trip(spark, tmp_path):
    rows = samples(spark)
    train, test = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    pipe = Pipeline(stages=[ml.RelevanceSelector(count=2), ml.NeighbourClassifier(featuresCol="selected", k=3, metric="cityblock", weights="squared_inverse")])
    model = pipe.fit(train)
    found = model.transform(test)
    assert found.columns == ["id", "label", "features", "selected", "prediction"] and found.count() == 50
    chosen = selection.rank(train.select(F.col("id").alias("row_id"), F.col("label").cast("int").alias("label"), F.col("features").alias("f")), "F", 2)
    assert model.stages[0].getChosen() == chosen and set(chosen) == {0, 2}
    both = rows.select(F.col("id").alias("row_id"), F.col("label").cast("int").alias("label"), (F.col("id") % 3 > 0).cast("int").alias("fold"), F.array(*[F.col("features")[i] for i in chosen]).alias("f"))
    wanted = {r["row_id"]: r["predicted"] for r in neighbors.classify(both, 3, "cityblock", "squared_inverse").filter("fold = 0").collect()}
    assert {r["id"]: int(r["prediction"]) for r in found.collect()} == wanted
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model").transform(test)
    assert sorted(map(tuple, again.select("id", "prediction").collect())) == sorted(map(tuple, found.select("id", "prediction").collect()))
    pipe.save(f"{tmp_path}/pipe")
    assert Pipeline.load(f"{tmp_path}/pipe").getStages()[1].getK() == 3


def test_cross_validator_chooses(spark):
    knn = ml.NeighbourClassifier()
    grid = ParamGridBuilder().addGrid(knn.k, [1, 5]).build()
    found = CrossValidator(estimator=knn, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), numFolds=2, seed=1).fit(samples(spark))
    assert len(found.avgMetrics) == 2 and min(found.avgMetrics) > 0.8
    assert found.bestModel.getK() in (1, 5)
