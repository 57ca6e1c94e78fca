"""Queries over whole chains: recordings cleaned by their components, neighbour information, models; and their SQL."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.operators import artifacts, classifiers, cleaning, kernel_machine, ml, runlog, selection, trees
from modeloom.plans import experiments, pipeline
from modeloom.plans import tables as T
from modeloom.plans.queries import _ALL, _LOCAL, _component_features
from modeloom.plans.source_queries import ORACLES, QUERIES, query
from modeloom.sources import datasource, matfile, recordings
from modeloom.sources.shared import shared_folder, written

__all__ = ["ORACLES", "QUERIES"]

FS = 128.0
#: Trees of a fold; 100 in the published comparison.
BAGS = 20


def _long(frame: DataFrame) -> DataFrame:
    return T.rounded(recordings.long_form(frame, "subject"))


# 8 to 30 Hz at 128 Hz: edges 2 Hz wide, 212 of them in the order; the taps of two low passes, each of unit sum, one less the other.
_FIR = f"""WITH {T.MONTAGE}, k AS (SELECT unnest(range(213)) AS k),
raw AS (SELECT k, (0.54 - 0.46 * cos(2 * pi() * k / 212)) * CASE WHEN k = 106 THEN 2 * 31 / 128.0 ELSE sin(2 * pi() * 31 / 128.0 * (k - 106)) / (pi() * (k - 106)) END AS upper,
(0.54 - 0.46 * cos(2 * pi() * k / 212)) * CASE WHEN k = 106 THEN 2 * 7 / 128.0 ELSE sin(2 * pi() * 7 / 128.0 * (k - 106)) / (pi() * (k - 106)) END AS lower FROM k),
taps AS (SELECT k - 106 AS lag, upper / (SELECT sum(upper) FROM raw) - lower / (SELECT sum(lower) FROM raw) AS h FROM raw), ends AS (SELECT subject, max(t) AS e FROM montage GROUP BY subject),
lagged AS (SELECT m.subject, m.channel, m.t, h, least(greatest(m.t - lag, 0), e) AS at FROM montage m JOIN ends USING (subject), taps)
SELECT CAST(l.subject AS BIGINT) AS subject, CAST(l.channel AS BIGINT) AS channel, CAST(l.t AS BIGINT) AS t, round(sum(h * m.x), 6) + 0.0 AS x FROM lagged l JOIN montage m ON m.subject = l.subject AND m.channel = l.channel AND m.t = l.at GROUP BY ALL"""


@query("art1_fir_bandpass", _FIR)
def _(s, d):
    return _long(cleaning.fir_bandpass(T.montage(s, d), 8.0, 30.0))


@query("art1_line_removal")
def _(s, d):
    return _long(cleaning.remove_line(T.montage(s, d), 50.0, window=1.0, step=0.25, bandwidth=8.0))


@query("art1_component_chain")
def _(s, d):
    """Filters, unmixing, features and thresholds of components, removal: each recording with what went and what is left."""
    done = cleaning.clean_by_components(T.montage(s, d), artifacts.electrodes(s), "subject", fs=FS, epoch=64, keep=written)
    power = F.aggregate(F.flatten("signal"), F.lit(0.0), lambda a, x: a + x * x)
    return done.select("subject", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), F.round(power, 3).alias("power"))


_EM = _ALL.replace("WITH ", "WITH RECURSIVE ", 1) + """, vals AS MATERIALIZED (UNPIVOT (SELECT ic, kurtosis, sed, sad, gdsf, mev FROM ft) ON kurtosis, sed, sad, gdsf, mev INTO NAME feature VALUE v),
span AS (SELECT feature, max(v) AS top, min(v) AS bottom, (max(v) + min(v)) / 2 AS middle FROM vals GROUP BY feature),
sides AS (SELECT feature, middle, v, v > middle + 0.01 * (top - middle) AS hi, v < middle - 0.01 * (middle - bottom) AS lo FROM vals JOIN span USING (feature)),
em(feature, step, m0, s0, p0, m1, s1, p1, go) AS (
  SELECT feature, 0, avg(v) FILTER (hi), coalesce(var_samp(v) FILTER (hi), 0), count(*) FILTER (hi) / (count(*) FILTER (hi OR lo))::DOUBLE, avg(v) FILTER (lo), coalesce(var_samp(v) FILTER (lo), 0), count(*) FILTER (lo) / (count(*) FILTER (hi OR lo))::DOUBLE, true FROM sides GROUP BY feature
  UNION ALL
  SELECT feature, step + 1, n0, t0, q0, n1, t1, q1, abs(n0 - m0) > 1e-4 AND abs(t0 - s0) > 1e-4 AND abs(q0 - p0) > 1e-4 AND abs(n1 - m1) > 1e-4 AND abs(t1 - s1) > 1e-4 AND abs(q1 - p1) > 1e-4 FROM (
    SELECT feature, step, m0, s0, p0, m1, s1, p1, sum(h * v) / sum(h) AS n0, sum(h * (v - m0) * (v - m0)) / sum(h) AS t0, avg(h) AS q0, sum((1 - h) * v) / sum(1 - h) AS n1, sum((1 - h) * (v - m1) * (v - m1)) / sum(1 - h) AS t1, avg(1 - h) AS q1 FROM (
      SELECT *, w0 / (w0 + w1) AS h FROM (
        SELECT em.*, v, p0 * CASE WHEN s0 = 0 THEN 1 ELSE exp(-(v - m0) * (v - m0) / (2 * s0)) / sqrt(2 * pi() * s0) END AS w0, p1 * CASE WHEN s1 = 0 THEN 1 ELSE exp(-(v - m1) * (v - m1) / (2 * s1)) / sqrt(2 * pi() * s1) END AS w1 FROM em JOIN vals USING (feature) WHERE go))
    GROUP BY feature, step, m0, s0, p0, m1, s1, p1)
),
last AS (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY feature ORDER BY step DESC) = 1),
abc AS (SELECT *, (s0 - s1) / 2 AS a, s1 * m0 - s0 * m1 AS b, ln(p0 * sqrt(s1) / (p1 * sqrt(s0))) * s0 * s1 + (m1 * m1 * s0 - m0 * m0 * s1) / 2 AS c FROM last JOIN span USING (feature)),
roots AS (SELECT *, CASE WHEN b * b - 4 * a * c >= 0 THEN (-b + sqrt(b * b - 4 * a * c)) / (2 * a) END AS r1, CASE WHEN b * b - 4 * a * c >= 0 THEN (-b - sqrt(b * b - 4 * a * c)) / (2 * a) END AS r2 FROM abc)"""
_LIMIT = "round(coalesce(CASE WHEN r1 < m1 OR r1 > m0 THEN r2 ELSE r1 END, middle), 6)"


@query("art6_two_gaussian_thresholds", _EM + f" SELECT feature, {_LIMIT} AS threshold FROM roots")
def _(s, d):
    return T.rounded(s.createDataFrame(sorted(artifacts.thresholds(_component_features(s, d)).items()), "feature string, threshold double"))


@query("art1_worst_components", _EM + f""", lim AS (SELECT feature, coalesce(CASE WHEN r1 < m1 OR r1 > m0 THEN r2 ELSE r1 END, middle) AS z FROM roots), bad AS (SELECT ic, sum(greatest(0, (v - z) / z)) AS b FROM vals JOIN lim USING (feature) GROUP BY ic)
SELECT ic, round(b, 6) AS badness FROM bad WHERE b > 0 ORDER BY b DESC, ic DESC LIMIT 2""")
def _(s, d):
    found = _component_features(s, d)
    return T.rounded(artifacts.worst(artifacts.badness(found, artifacts.thresholds(found))))


def _digamma(x: str) -> str:
    y = f"({x} + 6.0)"
    return f"(ln({y}) - 0.5 / {y} - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) - " + " - ".join(f"1 / ({x} + {i}.0)" for i in range(6)) + ")"


_UNIFORM = "(CAST('0x' || substr(dig, {}, 8) AS BIGINT) + 0.5) / 4294967296.0"
_RELEVANCE = f"""WITH {T.MATRIX}, st AS (SELECT feat, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd, avg(abs(v)) AS size FROM m GROUP BY feat),
h AS (SELECT feat, row_id, label, v / sd AS v, greatest(1, size / sd) AS size, md5(row_id || '|' || feat || '|42') AS dig FROM m JOIN st USING (feat)),
x AS (SELECT feat, row_id, label, CAST(round((v + 1e-10 * size * sqrt(-2 * ln({_UNIFORM.format(1)})) * cos(2 * pi() * {_UNIFORM.format(9)})) * 1e13) AS BIGINT) AS x FROM h),
cl AS (SELECT feat, label, count(*) AS own FROM x GROUP BY ALL HAVING count(*) > 1), k AS MATERIALIZED (SELECT x.*, own FROM x JOIN cl ON cl.feat = x.feat AND cl.label = x.label),
dist AS (SELECT a.feat, a.row_id, any_value(a.x) AS x, any_value(a.own) AS own, list_sort(list(abs(a.x - b.x))) AS ds FROM k a JOIN k b ON a.feat = b.feat AND a.label = b.label AND a.row_id <> b.row_id GROUP BY a.feat, a.row_id),
nd AS (SELECT feat, row_id, x, own, least(3, own - 1) AS near, greatest(1, ds[least(3, own - 1)]) AS d FROM dist),
w AS (SELECT nd.feat, nd.row_id, any_value(nd.own) AS own, any_value(near) AS near, count(*) AS m FROM nd JOIN k b ON b.feat = nd.feat AND abs(b.x - nd.x) < d GROUP BY nd.feat, nd.row_id),
i AS (SELECT feat, count(*) AS n, avg({_digamma('near')}) AS a, avg({_digamma('own')}) AS b, avg({_digamma('m')}) AS c FROM w GROUP BY feat)
SELECT CAST(f.feat AS BIGINT) AS feat, round(coalesce(greatest(0, {_digamma('n')} + a - b - c), 0), 6) + 0.0 AS mi FROM (SELECT DISTINCT feat FROM m) f LEFT JOIN i ON i.feat = f.feat"""


@query("mr2_neighbour_relevance", _RELEVANCE)
def _(s, d):
    return T.rounded(selection.neighbour_relevance(T.matrix(s, d), keep=written))


def _ten_folds(s, d):
    return T.matrix(s, d).withColumn("fold", (F.col("row_id") % 10).cast("int"))


@query("clf1_decision_tree")
def _(s, d):
    return T.rounded(classifiers.decision_tree(_ten_folds(s, d)))


@query("clf2_rbf_svm")
def _(s, d):
    return kernel_machine.cross_predict(_ten_folds(s, d)).select("row_id", "label", "predicted", F.round("probability", 3).alias("probability"))


@query("clf3_bagged_trees")
def _(s, d):
    return T.rounded(trees.bagged(_ten_folds(s, d), BAGS).drop("shares"))


@query("clf4_comparison")
def _(s, d):
    return classifiers.compare(_ten_folds(s, d), bags=BAGS).drop("ms_per_row")


# The chosen feature of the largest score, and the nearest two rows of the training part by it alone.
_PIPELINE = f"""WITH {T.MATRIX}, tr AS (SELECT * FROM m WHERE row_id % 5 <> 0), g AS (SELECT feat, label, count(*) AS n, avg(v) AS a, var_pop(v) * count(*) AS ss FROM tr GROUP BY ALL), t AS (SELECT feat, sum(n * a) / sum(n) AS grand FROM g GROUP BY feat),
best AS (SELECT arg_max(feat, (f, -feat)) AS feat FROM (SELECT g.feat, (sum(n * pow(a - grand, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM g JOIN t USING (feat) GROUP BY g.feat)),
d AS (SELECT x.row_id, y.label, round(abs(x.v - y.v), 12) AS d, y.row_id AS o FROM m x JOIN tr y ON x.feat = y.feat WHERE x.row_id % 5 = 0 AND x.feat = (SELECT feat FROM best)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, o) AS r FROM d) WHERE r <= 3), votes AS (SELECT row_id, label, count(*) AS n FROM near GROUP BY ALL)
SELECT row_id, CAST(arg_max(label, (n, -label)) AS DOUBLE) AS prediction FROM votes GROUP BY row_id"""


@query("mr10_selector_and_neighbours_in_a_pipeline", _PIPELINE)
def _(s, d):
    rows = T.matrix(s, d).withColumnRenamed("f", "features")
    stages = [ml.RelevanceSelector(count=1), ml.NeighbourClassifier(featuresCol="selected", k=3, metric="cityblock")]
    return Pipeline(stages=stages).fit(rows.filter("row_id % 5 <> 0")).transform(rows.filter("row_id % 5 = 0")).select("row_id", "prediction")


def _files(s, d) -> str:
    """A folder of archives of recordings, each of whose members is a row of embeddings as 4 channels of 16 samples."""
    folder = shared_folder(s)

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        store, root = datasource.opened(folder)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/part{key[0]}.zip") as out:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for i, x in sorted(zip(f["seg"], f["signal"], strict=True), key=lambda r: r[0]):
                    z.writestr(f"v{i}p.mat", matfile.write({f"v{i}p": np.stack(x)}))
            out.write(held.getvalue())
        return pd.DataFrame({"n": [len(f)]})

    T.multichannel(s, d).groupBy((F.col("seg") % 7).alias("part")).applyInPandas(run, "n long").agg(F.sum("n")).collect()
    return folder


@query("src6_data_source", f"WITH {T.CELLS} SELECT vec_id AS seg, CAST(p // 16 AS BIGINT) AS channel, CAST(p % 16 AS BIGINT) AS t, round(v, 6) + 0.0 AS x FROM cells")
def _(s, d):
    datasource.register(s)
    found = s.read.format("recordings").option("partitionBytes", 1 << 16).load(_files(s, d))
    return T.rounded(recordings.long_form(found.select(F.regexp_extract("subject", r"v(\d+)p", 1).cast("long").alias("seg"), "signal"), "seg"))


@query("src13_members_by_subject", "SELECT 'v' || vec_id || 'p' AS subject, CAST(4 AS BIGINT) AS n_channels FROM embeddings WHERE vec_id % 10 = 3")
def _(s, d):
    datasource.register(s)
    return T.rounded(s.read.format("recordings").load(_files(s, d)).filter("subject LIKE '%3p'").select("subject", "n_channels"))


def _recordings(s, d):
    """Recordings of 14 channels: in windows of 64 samples each has 126 features."""
    return T.montage(s, d).withColumn("label", (F.col("subject") % 2).cast("int"))


@query("drv2_experiment")
def _(s, d):
    """Cleaning, windows, modes, features, ranking and scaling in each of ten folds, metrics."""
    return T.rounded(pipeline.run(_recordings(s, d), "subject", experiments.EXPERIMENTS["DS2"], FS, 0.5, mode="A").metrics)


@query("drv3_experiments_from_recordings")
def _(s, d):
    """The settings of DS1, with as many features as published, under folds of windows."""
    matrix, out = None, None
    for name, e in experiments.EXPERIMENTS.items():
        if e.dataset == "DS1":
            log = runlog.RunLog(name)
            matrix = matrix or pipeline.build(_recordings(s, d), "subject", FS, 0.5, 0.5, e.alpha, "B", log)
            part = pipeline.judge(matrix, "subject", e, log).metrics.select(F.lit(name).alias("experiment"), "*")
            out = part if out is None else out.unionByName(part)
    return T.rounded(out)


@query("drv7_audit_of_protocols")
def _(s, d):
    """The settings of DS1 at rest under folds of windows, where a subject stands on both sides, and under folds of whole subjects."""
    found = pipeline.run(_recordings(s, d), "subject", experiments.EXPERIMENTS["DS1_Rest"], FS, 0.5)
    return T.rounded(found.metrics.select(F.lit("windows").alias("folds"), "*").unionByName(found.independent.select(F.lit("subjects").alias("folds"), "*")))


# Windows of 64 samples every 32; one that would end with its recording is left out unless it is the only one.
_LOGGED = """WITH r AS (SELECT vec_id // 112 AS subject, (max(vec_id // 14 % 8) + 1) * 64 AS n FROM embeddings GROUP BY 1), w AS (SELECT sum(greatest(1, CAST(floor((n - 65) / 32.0) AS BIGINT) + 1)) AS w FROM r)
SELECT * FROM (SELECT 0 AS position, 'preprocess' AS stage, count(*) AS n FROM r UNION ALL SELECT k, name, w FROM w, (VALUES (1, 'windows'), (2, 'modes_and_features'), (3, 'energy_integration'), (4, 'folds'), (5, 'windows_apart'), (6, 'subjects_apart')) AS s(k, name))"""


@query("drv9_run_log", "SELECT CAST(position AS BIGINT) AS position, stage, CAST(n AS BIGINT) AS n FROM (" + _LOGGED + ")")
def _(s, d):
    return T.rounded(pipeline.run(_recordings(s, d), "subject", experiments.EXPERIMENTS["DS1_Rest"], FS, 0.5).log.rows(s).select("position", "stage", F.col("rows").alias("n")))


def _selected_and_scaled(folds: int) -> str:
    """Eight features chosen on the rows outside a fold, scaled by those rows' means and deviations, and two neighbours there."""
    sql = _LOCAL.replace("% 5", f"% {folds}").replace("range(5)", f"range({folds})")
    stats = "sc AS (SELECT f, feat, avg(v) AS mean, stddev_pop(v) AS sd FROM tr GROUP BY ALL),\ndist AS ("
    sql = sql.replace("dist AS (", stats, 1).replace("round(sum(abs(a.v - b.v)), 12) AS d", "round(sum(abs((a.v - mean) / sd - (b.v - mean) / sd)), 12) AS d")
    return sql.replace("cho.feat = a.feat JOIN m b", "cho.feat = a.feat JOIN sc ON sc.f = cho.f AND sc.feat = cho.feat JOIN m b")


def _chain(rows: DataFrame) -> DataFrame:
    return T.rounded(experiments.evaluate(rows, 2, "cityblock", "uniform", 8, True).select("row_id", "fold", "label", "predicted"))


@query("cv5_selection_and_scaling_in_ten_folds", _selected_and_scaled(10))
def _(s, d):
    return _chain(_ten_folds(s, d))


@query("cv6_selection_and_scaling_without_a_subject", _selected_and_scaled(14))
def _(s, d):
    """Each subject by all others."""
    return _chain(T.matrix(s, d).withColumn("fold", F.col("grp").cast("int")))
