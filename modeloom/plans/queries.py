"""The queries over the test tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modeloom.functions import filters, wavelets
from modeloom.operators import artifacts, decompose, energy, features, folds, metrics, neighbors, segments, selection, signals, stats
from modeloom.plans import experiments
from modeloom.plans import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Windows


@query("seg1_sliding_windows", f"WITH {T.WINDOWS} SELECT subject, w, CAST(count(*) AS BIGINT) AS n, round(sum(x), 6) AS total, CAST(min(i) AS BIGINT) AS first_i, CAST(max(i) AS BIGINT) AS last_i FROM win GROUP BY ALL")
def _(s, d):
    return T.rounded(T.windows(s, d).groupBy("subject", "w").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("i").alias("first_i"), F.max("i").alias("last_i")))


@query("seg2_partial_windows", f"""WITH {T.SAMPLES}, lens AS (SELECT subject, count(*) AS n FROM samples GROUP BY subject),
w0 AS (SELECT subject, unnest(range(greatest(1, CAST(ceil((n - 15) / 7.0) AS BIGINT) + 1))) AS w FROM lens)
SELECT w0.subject, w0.w, round(coalesce(sum(x), 0), 6) AS total, 15 - CAST(count(x) AS BIGINT) AS padded FROM w0 LEFT JOIN samples s ON s.subject = w0.subject AND s.t >= w0.w * 7 AND s.t < w0.w * 7 + 15 GROUP BY ALL""")
def _(s, d):
    cut = segments.array_windows(T.recordings(s, d), T.SIZE, T.STEP, partial=True)
    held = cut.withColumn("v", F.get("signal", F.lit(0))).join(T.samples(s, d).groupBy("subject").agg(F.count("*").alias("n")), "subject")
    left = F.greatest(F.lit(0), F.lit(T.SIZE) - F.greatest(F.lit(0), F.least(F.lit(T.SIZE), F.col("n") - F.col("segment_index") * T.STEP)))
    return T.rounded(held.select("subject", F.col("segment_index").alias("w"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"), left.alias("padded")))


@query("seg3_segment_metadata", f"WITH {T.WINDOWS} SELECT DISTINCT subject, w AS segment_index, w * 7 AS start_sample, w * 7 + 15 AS end_sample, round(w * 7 / 128.0, 6) AS start_time_sec, round((w * 7 + 15) / 128.0, 6) AS end_time_sec, CAST(1 AS BIGINT) AS n_channels, CAST(15 AS BIGINT) AS window_samples, CAST(128.0 AS DOUBLE) AS fs FROM win")
def _(s, d):
    rows = T.windows(s, d).select("subject", F.col("w").alias("segment_index")).distinct()
    return T.rounded(segments.metadata(rows, T.SIZE, T.STEP, 128.0, 1))


@query("seg4_dataset_segments", f"WITH {T.WINDOWS} SELECT subject % 2 AS label, CAST(count(DISTINCT subject) AS BIGINT) AS subjects, CAST(count(DISTINCT subject * 1000 + w) AS BIGINT) AS segments FROM win GROUP BY 1")
def _(s, d):
    rows = segments.array_windows(T.recordings(s, d), T.SIZE, T.STEP)
    return rows.groupBy((F.col("subject") % 2).alias("label")).agg(F.count_distinct("subject").alias("subjects"), F.count("*").alias("segments"))


@query("seg5_count_verification", f"""WITH {T.WINDOWS}, f AS (SELECT subject, count(DISTINCT w) AS found FROM win GROUP BY 1)
SELECT l.subject, CAST(CASE WHEN n < 15 THEN 0 ELSE greatest(1, floor((n - 16) / 7.0) + 1) END AS BIGINT) AS expected, CAST(coalesce(found, 0) AS BIGINT) AS found, true AS matches FROM lens l LEFT JOIN f ON f.subject = l.subject""")
def _(s, d):
    expected = T.samples(s, d).groupBy("subject").agg(segments.count_of(F.count("*"), T.SIZE, T.STEP).alias("expected"))
    found = T.windows(s, d).select("subject", "w").distinct()
    return T.rounded(segments.verify_counts(found, expected, ["subject"]))


@query("seg6_integrity", f"WITH {T.WINDOWS}, g AS (SELECT subject, w, count(*) AS n FROM win GROUP BY ALL) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (n != 15) AS BIGINT) AS bad_shape, CAST(0 AS BIGINT) AS with_nan, CAST(0 AS BIGINT) AS with_inf, CAST(count(*) FILTER (subject IS NULL) AS BIGINT) AS no_subject, CAST(0 AS BIGINT) AS bad_label FROM g")
def _(s, d):
    rows = T.windows(s, d).groupBy("subject", "w").agg(F.collect_list("x").alias("values")).withColumn("label", F.col("subject") % 2)
    return segments.integrity(rows, T.SIZE)


@query("seg7_subject_filter", f"WITH {T.WINDOWS} SELECT w, i, x FROM win WHERE subject = 7")
def _(s, d):
    only = T.samples(s, d).filter("subject = 7")
    return T.rounded(segments.long_windows(only, T.SIZE, T.STEP, ["subject"]).select("w", "i", "x"))


_POS = f"WITH {T.WINDOWS}, p AS (SELECT subject, w, (row_number() OVER (PARTITION BY subject ORDER BY w) - 1) % 46 AS pos FROM (SELECT DISTINCT subject, w FROM win))"


def _positions(s, d):
    return segments.positions(T.windows(s, d).select("subject", "w").distinct(), "subject", ["w"], 46)


@query("seg8_window_position", _POS + " SELECT subject, w, pos FROM p")
def _(s, d):
    return T.rounded(_positions(s, d))


@query("seg9_zero_overlap", _POS + " SELECT subject, w FROM p WHERE pos % 2 = 0")
def _(s, d):
    return segments.without_overlap(_positions(s, d)).select("subject", F.col("w").cast("long").alias("w"))


# Features

def _features_sql(windows: str, n: int, fs: float) -> str:
    """SQL of all features over win(subject, w, i, x), which `windows` defines, with n samples a window."""
    return f"""WITH {windows},
base AS (SELECT subject, w, stddev_pop(x) AS std, var_pop(x) AS var, sqrt(avg(x * x)) AS rms, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, abs(sum(sqrt(abs(x)))) AS assr,
  var_pop(x * (0.54 - 0.46 * cos(2 * pi() * i / {n - 1}))) * {n} / ({fs} * {n // 2 + 1}) AS ap, 1.06 * stddev_pop(x) * pow({n}, -0.2) AS sigma FROM win GROUP BY ALL),
lagged AS (SELECT subject, w, i, x - lag(x) OVER (PARTITION BY subject, w ORDER BY i) AS d FROM win),
steps AS (SELECT l.subject, l.w, sum(d * d) AS sq, avg(exp(-0.5 * (d / sigma) * (d / sigma)) / (sqrt(2 * pi()) * sigma)) AS first FROM lagged l JOIN base b ON b.subject = l.subject AND b.w = l.w WHERE d IS NOT NULL GROUP BY ALL),
pairs AS (SELECT a.subject, a.w, sum(exp(-0.5 * ((a.x - b.x) / sigma) * ((a.x - b.x) / sigma)) / (sqrt(2 * pi()) * sigma)) AS s
  FROM win a JOIN win b ON a.subject = b.subject AND a.w = b.w JOIN base z ON z.subject = a.subject AND z.w = a.w WHERE std >= 1e-10 GROUP BY ALL),
feat AS (SELECT base.*, CASE WHEN sq > 0 THEN log10(sqrt(sq)) ELSE 0 END AS mfl, CASE WHEN std < 1e-10 THEN 0 ELSE s / {n * n} END AS ip,
  CASE WHEN std < 1e-10 THEN 0 ELSE first - (s - {n} / (sqrt(2 * pi()) * sigma)) / {2 * n * n} END AS pcc, coalesce(s, 0) AS pair_sum
  FROM base JOIN steps USING (subject, w) LEFT JOIN pairs USING (subject, w))"""


_FEATURE_SQL = _features_sql(T.WINDOWS, T.SIZE, T.FS)


def _feature(name: str, column: str):
    @query(name, f"{_FEATURE_SQL} SELECT subject, w, round({column}, 6) + 0.0 AS {column} FROM feat")
    def _(s, d):
        pairs = column in ("ip", "pcc", "sigma", "pair_sum")
        return T.rounded(features.grouped(T.windows(s, d), ["subject", "w"], T.FS, T.SIZE, pairs).select("subject", "w", column))


for _name, _column in (
    ("fea1_std", "std"), ("fea2_var", "var"), ("fea3_rms", "rms"), ("fea4_iqr", "iqr"), ("fea5_assr", "assr"), ("fea6_average_power", "ap"), ("fea7_mfl", "mfl"),
    ("fea8_information_potential", "ip"), ("fea9_centered_correntropy", "pcc"), ("fea10_silverman_sigma", "sigma"), ("fea11_gaussian_pair_sum", "pair_sum"),
):
    _feature(_name, _column)

_NINE = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("std", "var", "rms", "iqr", "assr", "ap", "mfl", "ip", "pcc"))


@query("fea12_nine_features", f"{_FEATURE_SQL} SELECT subject, w, {_NINE} FROM feat")
def nine_features(s, d):
    return T.rounded(features.grouped(T.windows(s, d), ["subject", "w"], T.FS, T.SIZE).drop("sigma", "pair_sum"))


@query("fea13_batch_extraction_arrow", f"{_FEATURE_SQL} SELECT subject, w, {_NINE} FROM feat")
def _(s, d):
    rows = segments.array_windows(T.recordings(s, d), T.SIZE, T.STEP).select("subject", F.col("segment_index").cast("long").alias("w"), F.get("signal", F.lit(0)).alias("values"))
    return T.rounded(features.fast(rows, ["subject", "w"], T.FS))


@query("fea14_feature_summary", "WITH c AS (SELECT vec_id, 1 + vec_id % 7 AS n_modes FROM embeddings) SELECT CAST(count(*) AS BIGINT) AS n_segments, CAST(min(n_modes) AS BIGINT) AS min_modes, CAST(max(n_modes) AS BIGINT) AS max_modes, round(avg(n_modes), 6) AS mean_modes FROM c")
def _(s, d):
    return T.rounded(features.summary(T.table(s, d, "embeddings").select((F.col("vec_id") % 7 + 1).alias("n_modes"))))


_RAW_SQL = _features_sql(f"{T.CELLS}, win AS (SELECT vec_id AS subject, p // 16 AS w, p % 16 AS i, v AS x FROM cells)", 16, 128.0)


@query("fea15_raw_channels", f"{_RAW_SQL} SELECT subject AS seg, CAST(w AS BIGINT) AS channel, {_NINE} FROM feat")
def _(s, d):
    rows = T.multichannel(s, d).select("seg", F.posexplode("signal").alias("channel", "values"))
    return T.rounded(features.fast(rows, ["seg", "channel"], 128.0))


# Energy

_ENERGY = f"WITH {T.MODES}, e AS (SELECT seg, k, channel, sum(x * x) AS energy, stddev_pop(x) AS std, var_pop(x) AS var, sqrt(avg(x * x)) AS rms FROM modes GROUP BY ALL)"
_WEIGHTED = _ENERGY + ", g AS (SELECT seg, channel, sum(std * energy) / (sum(energy) + 1e-12) AS std, sum(var * energy) / (sum(energy) + 1e-12) AS var, sum(rms * energy) / (sum(energy) + 1e-12) AS rms FROM e GROUP BY ALL)"
_VECTOR = _WEIGHTED + ", l AS (SELECT seg, channel * 3 + unnest([0, 1, 2]) AS j, unnest([std, var, rms]) AS v FROM g)"


def _mode_features(s, d):
    x = F.col("x")
    return T.modes(s, d).groupBy("seg", "k", "channel").agg(F.sum(x * x).alias("energy"), F.stddev_pop(x).alias("std"), F.var_pop(x).alias("var"), F.sqrt(F.avg(x * x)).alias("rms"))


@query("agg1_mode_energy", _ENERGY + " SELECT seg, k, channel, round(energy, 6) AS energy FROM e")
def _(s, d):
    return T.rounded(energy.mode_energy(T.modes(s, d), ["seg", "k", "channel"]))


@query("agg2_energy_weighted_average", _WEIGHTED + " SELECT seg, channel, round(std, 6) AS std, round(var, 6) AS var, round(rms, 6) AS rms FROM g")
def _(s, d):
    return T.rounded(energy.weighted(_mode_features(s, d), ["seg", "channel"], ["std", "var", "rms"]))


def _vectors(s, d):
    return energy.vectors(energy.weighted(_mode_features(s, d), ["seg", "channel"], ["std", "var", "rms"]), ["seg"], ["std", "var", "rms"])


@query("agg3_integrated_vectors", _VECTOR + " SELECT seg, CAST(j AS BIGINT) AS j, round(v, 6) AS v FROM l")
def _(s, d):
    return T.rounded(_vectors(s, d).select("seg", F.posexplode("f").alias("j", "v")))


@query("agg4_batch_integrate", _VECTOR + ", j AS (SELECT vec_id AS seg, unnest(range(8)) AS j FROM embeddings) SELECT j.seg, j.j, round(CASE WHEN j.seg % 10 = 3 THEN 0 ELSE coalesce(v, 0) END, 6) AS v FROM j LEFT JOIN l ON l.seg = j.seg AND l.j = j.j")
def _(s, d):
    all_segments = T.table(s, d, "embeddings").select(F.col("vec_id").alias("seg"))
    full = energy.complete(all_segments, _vectors(s, d).filter("seg % 10 != 3"), ["seg"], 8)
    return T.rounded(full.select("seg", F.posexplode("f").alias("j", "v")))


@query("agg5_matrix_verification", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(min(len(embedding)) AS BIGINT) AS min_size, CAST(max(len(embedding)) AS BIGINT) AS max_size, bool_and(len(embedding) = 64) AS shape_ok FROM embeddings")
def _(s, d):
    return T.rounded(T.matrix(s, d).agg(F.count("*").alias("n_rows"), F.min(F.size("f")).alias("min_size"), F.max(F.size("f")).alias("max_size"), F.bool_and(F.size("f") == 64).alias("shape_ok")))


@query("agg6_array_health", f"WITH {T.CELLS} SELECT CAST(count(*) AS BIGINT) AS n_values, CAST(64 AS BIGINT) AS min_size, CAST(64 AS BIGINT) AS max_size, CAST(count(*) FILTER (isnan(v)) AS BIGINT) AS n_nan, CAST(count(*) FILTER (isinf(v)) AS BIGINT) AS n_inf, round(min(v), 6) AS low, round(max(v), 6) AS high FROM cells")
def _(s, d):
    return T.rounded(energy.health(T.matrix(s, d)))


@query("agg7_tolerance_checks", f"WITH {T.WINDOWS}, c AS (SELECT count(*) AS n FROM (SELECT DISTINCT subject, w FROM win)) SELECT (SELECT n FROM c) = (SELECT sum(CASE WHEN n < 15 THEN 0 ELSE greatest(1, floor((n - 16) / 7.0) + 1) END) FROM lens) AS count_ok, abs(128.0 - 128.05) < 0.1 AS rate_ok, (SELECT bool_and(len(embedding) = 64) FROM embeddings) AS shape_ok")
def _(s, d):
    expected = T.samples(s, d).groupBy("subject").agg(segments.count_of(F.count("*"), T.SIZE, T.STEP).alias("e")).agg(F.sum("e").alias("e"))
    found = T.windows(s, d).select("subject", "w").distinct().agg(F.count("*").alias("n"))
    shape = T.matrix(s, d).agg(F.bool_and(F.size("f") == 64).alias("shape_ok"))
    return expected.join(found).join(shape).select((F.col("n") == F.col("e")).alias("count_ok"), (F.abs(F.lit(128.0) - 128.05) < 0.1).alias("rate_ok"), "shape_ok")


_COUNTS = "c AS (SELECT vec_id, label % 2 AS label, 1 + (vec_id * 7) % 22 AS v FROM embeddings)"


def _mode_counts(s, d):
    return T.table(s, d, "embeddings").select("vec_id", (F.col("label") % 2).alias("label"), (F.col("vec_id") * 7 % 22 + 1).alias("v"))


_MODE_STATS = f"WITH {_COUNTS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, CAST(count(*) FILTER (v >= 20) AS BIGINT) AS at_cap, round(count(*) FILTER (v >= 20) * 100.0 / count(*), 6) AS pct_at_cap, min(v) != max(v) AS varies FROM c"


@query("agg8_mode_count_statistics", _MODE_STATS)
def _(s, d):
    return T.rounded(decompose.mode_statistics(_mode_counts(s, d), "v"))


@query("dec6_decomposition_statistics", _MODE_STATS)
def _(s, d):
    return T.rounded(decompose.mode_statistics(_mode_counts(s, d), "v"))


@query("agg9_per_class_statistics", f"WITH {_COUNTS} SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, CAST(min(v) AS BIGINT) AS low, CAST(max(v) AS BIGINT) AS high FROM c GROUP BY GROUPING SETS ((), (label))")
def _(s, d):
    return T.rounded(stats.by_class(_mode_counts(s, d)))


@query("agg10_mann_whitney_u", f"""WITH {_COUNTS}, r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY v) AS t FROM c)
SELECT CAST(count(*) FILTER (label = 1) AS BIGINT) AS n1, CAST(count(*) FILTER (label = 0) AS BIGINT) AS n0, round(sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0, 6) AS u, CAST(sum(t * t - 1) AS BIGINT) AS ties FROM r""")
def _(s, d):
    return T.rounded(stats.rank_sums(_mode_counts(s, d)).withColumn("u", F.col("u").cast("double")).withColumn("ties", F.col("ties").cast("long")))


@query("agg11_histogram", f"WITH {_COUNTS} SELECT CAST(label AS BIGINT) AS label, CAST(v AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS density FROM c GROUP BY label, v")
def _(s, d):
    return T.rounded(stats.histogram(_mode_counts(s, d)))


@query("agg12_dataset_counts", _POS + """, e AS (SELECT subject, subject % 2 AS y, count(*) AS n, count(*) FILTER (pos % 2 = 0) AS even FROM p GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS segments_total, CAST(sum(n) FILTER (y = 0) AS BIGINT) AS segments_control, CAST(sum(n) FILTER (y = 1) AS BIGINT) AS segments_disorder, CAST(count(*) AS BIGINT) AS subjects_total,
CAST(count(*) FILTER (y = 0) AS BIGINT) AS subjects_control, CAST(count(*) FILTER (y = 1) AS BIGINT) AS subjects_disorder, CAST(sum(even) AS BIGINT) AS segments_overlap0, CAST(min(n) AS BIGINT) AS per_subject_min, CAST(max(n) AS BIGINT) AS per_subject_max FROM e""")
def _(s, d):
    return T.rounded(stats.dataset_counts(_positions(s, d).withColumn("label", F.col("subject") % 2)))


# Predictions and metrics

_VOTE = f"""WITH {T.PREDICTIONS}, v AS (SELECT grp, CASE WHEN avg(CAST(label = 1 AS INT)) > 0.5 THEN 1 ELSE 0 END AS label, count(*) AS n_segments, avg(CAST(label = predicted AS INT)) AS segment_accuracy,
avg(CAST(predicted = 1 AS INT)) AS fraction_predicted FROM pred GROUP BY grp),
s AS (SELECT *, CASE WHEN fraction_predicted > 0.5 THEN 1 ELSE 0 END AS majority_vote, fraction_predicted = 0.5 AS tie, CAST((fraction_predicted > 0.5) = (label = 1) AS INT) AS vote_correct FROM v)"""


@query("agg13_per_subject_summary", _VOTE + """ SELECT CAST(count(*) AS BIGINT) AS n_subjects, CAST(sum(vote_correct) AS BIGINT) AS votes_correct, round(avg(vote_correct), 6) AS vote_accuracy, CAST(count(*) FILTER (tie) AS BIGINT) AS ties,
CAST(count(*) FILTER (segment_accuracy < 0.5) AS BIGINT) AS n_below_half, CAST(count(*) FILTER (segment_accuracy = 0) AS BIGINT) AS n_zero, CAST(count(*) FILTER (segment_accuracy = 1) AS BIGINT) AS n_perfect, round(min(segment_accuracy), 6) AS low, round(max(segment_accuracy), 6) AS high, round(median(segment_accuracy), 6) AS median FROM s""")
def _(s, d):
    return T.rounded(metrics.vote_summary(metrics.majority_vote(T.predictions(s, d), "grp")))


@query("met9_subject_majority_vote", _VOTE + " SELECT grp, CAST(label AS BIGINT) AS label, CAST(n_segments AS BIGINT) AS n_segments, round(segment_accuracy, 6) AS segment_accuracy, round(fraction_predicted, 6) AS fraction_predicted, CAST(majority_vote AS BIGINT) AS majority_vote, tie, CAST(vote_correct AS BIGINT) AS vote_correct FROM s")
def _(s, d):
    return T.rounded(metrics.majority_vote(T.predictions(s, d), "grp"))


@query("met10_subject_label", _VOTE + " SELECT grp, CAST(label AS BIGINT) AS label FROM s")
def _(s, d):
    return T.rounded(metrics.majority_vote(T.predictions(s, d), "grp").select("grp", "label"))


@query("met1_confusion_matrix", f"WITH {T.PREDICTIONS} SELECT CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted, CAST(count(*) AS BIGINT) AS n FROM pred GROUP BY label, predicted")
def _(s, d):
    return T.rounded(metrics.confusion(T.predictions(s, d)))


_BINARY = f"""WITH {T.PREDICTIONS}, c AS (SELECT CAST(count(*) FILTER (label = 0 AND predicted = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (label = 0 AND predicted = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 1 AND predicted = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (label = 1 AND predicted = 1) AS DOUBLE) AS tp FROM pred),
q AS (SELECT *, tn + fp + fn + tp AS n, tn + fp AS n0, fn + tp AS n1, tn / (tn + fp) AS r0, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tp / (tp + fp) AS p1 FROM c),
z AS (SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, (tn + tp) / n AS accuracy, (p0 * n0 + p1 * n1) / n AS precision, (r0 * n0 + r1 * n1) / n AS recall,
(2 * p0 * r0 / (p0 + r0) * n0 + 2 * p1 * r1 / (p1 + r1) * n1) / n AS f1, (r0 + r1) / 2 AS balanced_accuracy, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc,
((tn + tp) / n - (n0 * (tn + fn) + n1 * (tp + fp)) / (n * n)) / (1 - (n0 * (tn + fn) + n1 * (tp + fp)) / (n * n)) AS kappa, sqrt(r0 * r1) * 100 AS gdr, sqrt(tp / (n1 + 1e-10) * (tn / (n0 + 1e-10))) AS gmean FROM q)"""


def _binary(s, d):
    return T.rounded(metrics.binary_metrics(metrics.binary_counts(T.predictions(s, d))))


def _metric(name: str, *columns: str):
    @query(name, f"{_BINARY} SELECT {', '.join(c if c in ('tn', 'fp', 'fn', 'tp') else f'round({c}, 6) AS {c}' for c in columns)} FROM z")
    def _(s, d):
        return _binary(s, d).select(*columns)


_metric("met2_weighted_scores", "accuracy", "precision", "recall", "f1")
_metric("met3_mcc_kappa", "mcc", "kappa")
_metric("met4_gdr", "gdr")
_metric("met5_gmean", "gmean")
_metric("met11_full_metric_set", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "balanced_accuracy", "mcc", "kappa", "gdr", "gmean")

_SCORES = "s AS (SELECT quality AS label, doc_id % 97 AS score FROM labels)"
_ROC = f"""WITH {_SCORES}, g AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS q FROM s GROUP BY score), t AS (SELECT sum(p) AS np, sum(q) AS nq FROM g),
r AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER w / np AS tpr, sum(q) OVER w / nq AS fpr, p, np FROM g, t WINDOW w AS (ORDER BY score DESC))"""


def _roc(s, d):
    return metrics.roc_points(T.table(s, d, "labels").select(F.col("quality").alias("label"), (F.col("doc_id") % 97).alias("score")))


@query("met6_roc_pr_auc", _ROC + """, l AS (SELECT (fpr - coalesce(lag(fpr) OVER (ORDER BY score DESC), 0)) * (tpr + coalesce(lag(tpr) OVER (ORDER BY score DESC), 0)) / 2 AS a, tp / (tp + fp) * (p / np) AS b FROM r) SELECT round(sum(a), 6) AS roc_auc, round(sum(b), 6) AS pr_auc FROM l""")
def _(s, d):
    return T.rounded(metrics.areas(_roc(s, d)))


@query("met7_roc_curve", _ROC + " SELECT score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r")
def _(s, d):
    return T.rounded(_roc(s, d).select("score", "tp", "fp", "tpr", "fpr"))


@query("met8_fold_accuracy", f"WITH {T.PREDICTIONS}, f AS (SELECT fold, avg(CAST(label = predicted AS INT)) AS a FROM pred GROUP BY fold) SELECT CAST(count(*) AS BIGINT) AS n_folds, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM f")
def _(s, d):
    return T.rounded(metrics.fold_summary(T.predictions(s, d)))


@query("met12_row_normalised_matrix", f"WITH {T.PREDICTIONS}, c AS (SELECT label, predicted, count(*) AS n FROM pred GROUP BY label, predicted) SELECT CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted, CAST(n AS BIGINT) AS n, round(n * 100.0 / sum(n) OVER (PARTITION BY label), 6) AS pct FROM c")
def _(s, d):
    return T.rounded(metrics.row_shares(metrics.confusion(T.predictions(s, d))))


# Joins


@query("jn1_info_lookup", "SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS BIGINT) AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def _(s, d):
    return T.table(s, d, "documents").select("doc_id").join(T.table(s, d, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("long").alias("label"))


_TARGET_ROWS = ", ".join(f"('{e}', '{m}', {v})" for e, row in metrics.TARGETS.items() for m, v in row.items())


@query("jn2_target_comparison", f"""{_BINARY}, found AS (SELECT 'DS2' AS experiment, unnest(['accuracy', 'precision', 'recall', 'f1', 'mcc', 'kappa', 'gdr', 'gmean']) AS metric, unnest([accuracy, precision, recall, f1, mcc, kappa, gdr, gmean]) AS value FROM z),
wanted(experiment, metric, target) AS (VALUES {_TARGET_ROWS})
SELECT experiment, metric, round(value, 6) AS value, round(target, 6)::DOUBLE AS target, round(value - target, 6) AS diff, abs(value - target) < 0.005 AS matches FROM found JOIN wanted USING (experiment, metric)""")
def _(s, d):
    names = ["accuracy", "precision", "recall", "f1", "mcc", "kappa", "gdr", "gmean"]
    wide = metrics.binary_metrics(metrics.binary_counts(T.predictions(s, d)))
    found = wide.select(F.lit("DS2").alias("experiment"), F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("metric", "value"))
    return T.rounded(metrics.compare(found, metrics.targets(s)))


@query("jn3_alignment_check", "SELECT CAST(count(*) AS BIGINT) AS n, bool_and(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS same_rows, CAST(count(*) FILTER (a.doc_id IS NULL OR b.doc_id IS NULL) AS BIGINT) AS unmatched FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id")
def _(s, d):
    a, b = T.table(s, d, "documents").select(F.col("doc_id").alias("i")), T.table(s, d, "labels").select(F.col("doc_id").alias("j"))
    both = F.col("i").isNotNull() & F.col("j").isNotNull()
    return a.join(b, F.col("i") == F.col("j"), "full").agg(F.count("*").alias("n"), F.bool_and(both).alias("same_rows"), F.count_if(~both).alias("unmatched"))


# Nearest neighbours

_FOLDED = T.MATRIX.replace("vec_id % 14 AS grp", "vec_id % 14 AS grp, vec_id % 5 AS fold")
_DIST = {
    "cityblock": "sum(abs(a.v - b.v))", "euclidean": "sqrt(sum((a.v - b.v) * (a.v - b.v)))", "chebyshev": "max(abs(a.v - b.v))",
    "cosine": "1 - sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)))",
}
_WEIGHT = {"uniform": "1.0", "distance": "1 / d", "squared_inverse": "1 / (d * d + 1e-10)"}


def _knn_sql(metric: str, k: int, weights: str, matrix: str = f"WITH {_FOLDED}", label: str = "label") -> str:
    return f"""{matrix}, dist AS (SELECT a.row_id, b.row_id AS train_id, any_value(b.{label}) AS y, round({_DIST[metric]}, 12) AS d FROM m a JOIN m b ON a.feat = b.feat AND a.fold != b.fold GROUP BY a.row_id, b.row_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, train_id) AS r FROM dist) WHERE r <= {k}),
votes AS (SELECT row_id, y, sum({_WEIGHT[weights]}) AS w FROM near GROUP BY row_id, y),
best AS (SELECT row_id, y AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(w, 9) DESC, y) AS q FROM votes) WHERE q = 1)"""


def _folded(s, d):
    return T.matrix(s, d).withColumn("fold", (F.col("row_id") % 5).cast("int"))


def _knn(name: str, metric: str, k: int, weights: str):
    @query(name, _knn_sql(metric, k, weights) + " SELECT DISTINCT m.row_id, CAST(m.label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted FROM m JOIN best USING (row_id)")
    def _(s, d):
        return T.rounded(neighbors.classify(_folded(s, d), k, metric, weights).select("row_id", "label", "predicted"))


_knn("knn1_cityblock_k2_uniform", "cityblock", 2, "uniform")
_knn("knn2_euclidean_k1", "euclidean", 1, "uniform")
_knn("knn2_chebyshev_k5", "chebyshev", 5, "uniform")
_knn("knn2_cosine_k2_squared_inverse", "cosine", 2, "squared_inverse")
_knn("knn3_euclidean_k3_inverse_distance", "euclidean", 3, "distance")
_knn("knn4_cityblock_k4_vote", "cityblock", 4, "squared_inverse")

_SCALED = f"WITH {_FOLDED.replace(' m AS ', ' m0 AS ')}, st AS (SELECT feat, avg(v) AS a, stddev_pop(v) AS b FROM m0 GROUP BY feat), m AS (SELECT row_id, label, grp, fold, m0.feat, (v - a) / CASE WHEN b > 0 THEN b ELSE 1 END AS v FROM m0 JOIN st USING (feat))"


@query("knn5_standardise", _SCALED + " SELECT row_id, CAST(feat AS BIGINT) AS feat, round(v, 6) + 0.0 AS v FROM m")
def _(s, d):
    scaled = neighbors.standardise(_folded(s, d), by_fold=False)
    return T.rounded(scaled.select("row_id", F.posexplode("f").alias("feat", "v")))


@query("knn6_subject_probe", _knn_sql("euclidean", 1, "uniform", _SCALED, "grp") + " SELECT DISTINCT m.row_id, CAST(m.grp AS BIGINT) AS grp, CAST(predicted AS BIGINT) AS predicted FROM m JOIN best USING (row_id)")
def _(s, d):
    rows = neighbors.standardise(_folded(s, d), by_fold=False).withColumn("label", F.col("grp").cast("int"))
    return T.rounded(neighbors.classify(rows, 1, "euclidean").select("row_id", "grp", "predicted"))


@query("knn7_silhouette", f"""WITH {T.MATRIX}, dist AS (SELECT a.row_id, b.row_id AS o, any_value(a.label) AS ya, any_value(b.label) AS yb, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM m a JOIN m b ON a.feat = b.feat AND a.row_id != b.row_id GROUP BY a.row_id, b.row_id),
g AS (SELECT row_id, ya, yb, avg(d) AS d FROM dist GROUP BY ALL), s AS (SELECT row_id, min(d) FILTER (ya = yb) AS a, min(d) FILTER (ya != yb) AS b FROM g GROUP BY row_id)
SELECT row_id, round((b - a) / greatest(a, b), 6) + 0.0 AS s FROM s""")
def _(s, d):
    return T.rounded(neighbors.silhouette(T.matrix(s, d), "label"))


# Folds


@query("cv1_stratified_folds_dealt", "SELECT vec_id AS row_id, CAST(label % 2 AS BIGINT) AS label, (row_number() OVER (PARTITION BY label % 2 ORDER BY vec_id) - 1) % 10 AS fold FROM embeddings")
def _(s, d):
    return T.rounded(folds.dealt(T.matrix(s, d), 10).select("row_id", "label", "fold"))


@query("cv3_leave_one_group_out", "SELECT vec_id AS row_id, vec_id % 14 AS grp, dense_rank() OVER (ORDER BY vec_id % 14) - 1 AS fold FROM embeddings")
def _(s, d):
    return T.rounded(folds.leave_one_out(T.matrix(s, d), "grp").select("row_id", "grp", "fold"))


@query("cv1_stratified_kfold_shuffled")
def _(s, d):
    return T.rounded(folds.stratified(T.matrix(s, d)).select("row_id", "label", "fold"))


@query("cv1_seeded_shuffle", "SELECT vec_id AS row_id, CAST(label % 2 AS BIGINT) AS label, (row_number() OVER (PARTITION BY label % 2 ORDER BY md5('42:' || vec_id)) - 1) % 10 AS fold FROM embeddings")
def _(s, d):
    return T.rounded(folds.shuffled(T.matrix(s, d)).select("row_id", "label", "fold"))


# One step a group: the loads of 5 folds, and the fold that the group joins. Of equally even folds the first of the lightest is taken.
_BY_GROUP = "WITH RECURSIVE g AS (SELECT vec_id % 14 AS grp, count(*) AS n, list_value(count(*) FILTER (label % 2 = 0), count(*) FILTER (label % 2 = 1))::DOUBLE[] AS c FROM embeddings GROUP BY 1), "
_FOLDED = " SELECT vec_id AS row_id, vec_id % 14 AS grp, CAST(fold - 1 AS BIGINT) AS fold FROM embeddings JOIN st ON st.grp = vec_id % 14"
_GROUPED = _BY_GROUP + """o AS (SELECT *, row_number() OVER (ORDER BY n DESC, grp DESC) AS i FROM g),
st(i, loads, grp, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT o.i, loads[:f - 1] || [loads[f] + o.n] || loads[f + 1:], o.grp, f FROM (SELECT *, CAST(list_position(loads, list_min(loads)) AS BIGINT) AS f FROM st) s JOIN o ON o.i = s.i + 1)""" + _FOLDED
_SPREAD = "list_aggregate(a[:f - 1] || [a[f] + o.c[1]] || a[f + 1:], 'stddev_pop') / t0 + list_aggregate(b[:f - 1] || [b[f] + o.c[2]] || b[f + 1:], 'stddev_pop') / t1"
_STRATIFIED = _BY_GROUP + f"""tt AS (SELECT sum(c[1]) AS t0, sum(c[2]) AS t1 FROM g), o AS (SELECT *, row_number() OVER (ORDER BY abs(c[1] - c[2]) DESC, grp) AS i FROM g, tt),
st(i, a, b, grp, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::DOUBLE[], [0, 0, 0, 0, 0]::DOUBLE[], NULL::BIGINT, NULL::BIGINT UNION ALL
SELECT i, a[:f - 1] || [a[f] + c[1]] || a[f + 1:], b[:f - 1] || [b[f] + c[2]] || b[f + 1:], grp, f FROM (SELECT o.i, a, b, o.c, o.grp, f,
row_number() OVER (PARTITION BY o.i ORDER BY round(({_SPREAD}) / 2, 9), a[f] + b[f], f) AS best FROM (SELECT * FROM st, range(1, 6) AS r(f)) s JOIN o ON o.i = s.i + 1) WHERE best = 1)""" + _FOLDED


@query("cv2_stratified_group_kfold", _STRATIFIED)
def _(s, d):
    return T.rounded(folds.stratified_grouped(T.matrix(s, d), "grp", 5).select("row_id", "grp", "fold"))


@query("cv4_group_kfold", _GROUPED)
def _(s, d):
    return T.rounded(folds.grouped(T.matrix(s, d), "grp", 5).select("row_id", "grp", "fold"))


_POOLED = _knn_sql("cityblock", 2, "uniform") + ", o AS (SELECT DISTINCT m.row_id, m.label, m.grp, m.fold, predicted FROM m JOIN best USING (row_id))"


@query("cv5_pooled_evaluation", _POOLED + " SELECT CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted, CAST(count(*) AS BIGINT) AS n FROM o GROUP BY label, predicted")
def _(s, d):
    return T.rounded(metrics.confusion(experiments.evaluate(_folded(s, d), 2, "cityblock", "uniform")))


@query("cv6_subject_independent_evaluation", _knn_sql("cityblock", 2, "uniform", f"WITH {T.MATRIX.replace('vec_id % 14 AS grp', 'vec_id % 14 AS grp, vec_id % 14 AS fold')}") + ", o AS (SELECT DISTINCT m.row_id, m.label, m.grp, m.fold, predicted FROM m JOIN best USING (row_id)), f AS (SELECT fold, avg(CAST(label = predicted AS INT)) AS a FROM o GROUP BY fold) SELECT CAST(count(*) AS BIGINT) AS n_folds, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std FROM f")
def _(s, d):
    return T.rounded(metrics.fold_summary(experiments.evaluate(folds.leave_one_out(T.matrix(s, d), "grp"), 2, "cityblock", "uniform")))


@query("cv7_protocol_covers_every_row", _POOLED + " SELECT (SELECT count(*) FROM embeddings) AS n_rows, CAST(count(*) AS BIGINT) AS predicted_rows, CAST(count(DISTINCT row_id) AS BIGINT) AS distinct_rows FROM o")
def _(s, d):
    rows = _folded(s, d)
    return rows.agg(F.count("*").alias("n_rows")).join(experiments.evaluate(rows, 2, "cityblock", "uniform").agg(F.count("*").alias("predicted_rows"), F.count_distinct("row_id").alias("distinct_rows")))


@query("cv8_pooled_predictions", _POOLED + " SELECT row_id, CAST(fold AS BIGINT) AS fold, CAST(label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted FROM o")
def _(s, d):
    return T.rounded(experiments.evaluate(_folded(s, d), 2, "cityblock", "uniform").select("row_id", "fold", "label", "predicted"))


_SETTING_ROWS = ", ".join(f"('{n}', {e.keep}, {e.k}, '{e.metric}', '{e.weights}', {str(e.standardise).lower()})" for n, e in experiments.EXPERIMENTS.items())


@query("cv9_experiment_settings", f"SELECT experiment, CAST(keep AS BIGINT) AS keep, CAST(k AS BIGINT) AS k, metric, weights, standardise, least(keep, (SELECT max(len(embedding)) FROM embeddings))::BIGINT AS kept, (k * (SELECT count(*) FROM embeddings))::BIGINT AS votes FROM (VALUES {_SETTING_ROWS}) AS t(experiment, keep, k, metric, weights, standardise)")
def _(s, d):
    """The published settings, with how many features they keep of a table's and how many votes its rows get."""
    rows = [(n, e.keep, e.k, e.metric, e.weights, e.standardise) for n, e in experiments.EXPERIMENTS.items()]
    known = s.createDataFrame(rows, "experiment string, keep long, k long, metric string, weights string, standardise boolean")
    size = T.matrix(s, d).agg(F.count("*").alias("n"), F.max(F.size("f")).alias("width"))
    return known.join(F.broadcast(size)).select(*known.columns, F.least("keep", F.col("width").cast("long")).alias("kept"), (F.col("k") * F.col("n")).alias("votes"))


# Feature selection

_ANOVA = f"""WITH {T.MATRIX}, g AS (SELECT feat, label, count(*) AS n, avg(v) AS a, var_pop(v) * count(*) AS ss FROM m GROUP BY ALL), t AS (SELECT feat, sum(n * a) / sum(n) AS grand FROM g GROUP BY feat),
f AS (SELECT g.feat, (sum(n * pow(a - grand, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f_score FROM g JOIN t ON t.feat = g.feat GROUP BY g.feat)"""


@query("mr5_anova_f", _ANOVA + " SELECT CAST(feat AS BIGINT) AS feat, round(f_score, 6) AS f_score FROM f")
def _(s, d):
    return T.rounded(selection.anova(T.matrix(s, d)))


_CORR = ", r AS (SELECT a.feat AS a, b.feat AS b, corr(a.v, b.v) AS r FROM m a JOIN m b ON a.row_id = b.row_id AND a.feat < b.feat GROUP BY a.feat, b.feat)"


@query("mr5_correlations", f"WITH {T.MATRIX}{_CORR} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(r, 6) + 0.0 AS r FROM r")
def _(s, d):
    return T.rounded(selection.correlations(T.matrix(s, d)))


_GREEDY_FROM = ", p AS (SELECT a, b, abs(r) AS r FROM r UNION ALL SELECT b, a, abs(r) FROM r), s0 AS (SELECT 1 AS k, [(SELECT feat FROM f ORDER BY f_score DESC, feat LIMIT 1)] AS chosen)"


_GREEDY = lambda count: "WITH RECURSIVE " + _ANOVA.removeprefix("WITH ") + _CORR + _GREEDY_FROM + """, pick(k, chosen) AS (SELECT * FROM s0 UNION ALL
SELECT k + 1, list_append(chosen, (SELECT f.feat FROM f JOIN p ON p.a = f.feat AND list_contains(chosen, p.b) WHERE NOT list_contains(chosen, f.feat) GROUP BY f.feat, f.f_score ORDER BY round(f.f_score - avg(p.r), 9) DESC, f.feat LIMIT 1)) FROM pick WHERE k < """ + str(count) + ") SELECT CAST(k AS BIGINT) AS rank, CAST(chosen[k] AS BIGINT) AS feat FROM pick"  # noqa: E731


@query("mr4_greedy_selection", _GREEDY(12))
def _(s, d):
    order = selection.rank(T.matrix(s, d), "F", 12)
    return s.createDataFrame([(i + 1, f) for i, f in enumerate(order)], "rank long, feat long")


@query("mr8_global_ranking", _GREEDY(64))
def _(s, d):
    return s.createDataFrame([(i + 1, f) for i, f in enumerate(selection.rank(T.matrix(s, d), "F"))], "rank long, feat long")


@query("mr6_binned_information", f"""WITH {T.MATRIX}, sp AS (SELECT feat, min(v) AS low, max(v) AS high FROM m GROUP BY feat),
b AS (SELECT row_id, m.feat, CASE WHEN v >= high THEN 10 ELSE greatest(1, least(10, CAST(floor((v - low) / ((high - low) / 9)) AS INT) + 1)) END AS bin FROM m JOIN sp ON sp.feat = m.feat),
j AS (SELECT x.feat AS a, y.feat AS b, x.bin AS i, y.bin AS j, count(*) AS n FROM b x JOIN b y ON x.row_id = y.row_id AND x.feat < y.feat GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY a, b) AS t, sum(n) OVER (PARTITION BY a, b, i) AS ni, sum(n) OVER (PARTITION BY a, b, j) AS nj FROM j)
SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(greatest(0, sum(n / t * ln(n * t / (ni * nj)))), 6) AS mi FROM c GROUP BY a, b""")
def _(s, d):
    pairs = s.range(64 * 64).select((F.col("id") / 64).cast("int").alias("a"), (F.col("id") % 64).cast("int").alias("b")).filter("a < b")
    return T.rounded(selection.binned_information(T.matrix(s, d), pairs))


@query("mr10_selector_transformer", "WITH RECURSIVE " + _ANOVA.removeprefix("WITH ") + " SELECT row_id, CAST(0 AS BIGINT) AS j, round(v, 6) + 0.0 AS v FROM m WHERE feat = (SELECT feat FROM f ORDER BY f_score DESC, feat LIMIT 1)")
def _(s, d):
    rows = T.matrix(s, d)
    return T.rounded(selection.Selector(1).fit(rows).transform(rows).select("row_id", F.posexplode("f").alias("j", "v")))


@query("mr1_ranking_by_information")
def _(s, d):
    return s.createDataFrame([(i + 1, f) for i, f in enumerate(selection.rank(T.matrix(s, d), "MI"))], "rank long, feat long")


@query("mr3_neighbour_redundancy")
def _(s, d):
    return T.rounded(selection.neighbour_redundancy(T.matrix(s, d)))


# Chosen on the rows outside a fold f, for each fold by itself; the tested rows of the fold then see only those features.
_LOCAL = f"""WITH RECURSIVE {T.MATRIX}, tr AS MATERIALIZED (SELECT CAST(r.f AS INT) AS f, m.* FROM m, range(5) AS r(f) WHERE row_id % 5 != r.f),
g AS (SELECT f, feat, label, count(*) AS n, avg(v) AS a, var_pop(v) * count(*) AS ss FROM tr GROUP BY ALL), t AS (SELECT f, feat, sum(n * a) / sum(n) AS grand FROM g GROUP BY ALL),
fs AS MATERIALIZED (SELECT g.f, g.feat, (sum(n * pow(a - grand, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f_score FROM g JOIN t ON t.feat = g.feat AND t.f = g.f GROUP BY g.f, g.feat),
r AS MATERIALIZED (SELECT x.f, x.feat AS a, y.feat AS b, abs(corr(x.v, y.v)) AS r FROM tr x JOIN tr y ON x.f = y.f AND x.row_id = y.row_id AND x.feat != y.feat GROUP BY ALL),
pick(f, k, chosen) AS (SELECT f, 1, [arg_max(feat, (f_score, -feat))] FROM fs GROUP BY f UNION ALL
SELECT f, k + 1, list_append(chosen, feat) FROM (SELECT p.f, k, chosen, fs.feat, row_number() OVER (PARTITION BY p.f ORDER BY round(any_value(f_score) - avg(r.r), 9) DESC, fs.feat) AS best
FROM pick p JOIN fs ON fs.f = p.f AND NOT list_contains(chosen, fs.feat) JOIN r ON r.f = p.f AND r.a = fs.feat AND list_contains(chosen, r.b) WHERE k < 8 GROUP BY p.f, k, chosen, fs.feat) WHERE best = 1),
cho AS (SELECT f, unnest(chosen) AS feat FROM pick WHERE k = 8),
dist AS (SELECT a.row_id, b.row_id AS train_id, any_value(b.label) AS y, round(sum(abs(a.v - b.v)), 12) AS d FROM m a JOIN cho ON cho.f = a.row_id % 5 AND cho.feat = a.feat JOIN m b ON a.feat = b.feat AND b.row_id % 5 != a.row_id % 5 GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, train_id) AS i FROM dist), votes AS (SELECT row_id, y, count(*) AS w FROM near WHERE i <= 2 GROUP BY ALL),
best AS (SELECT row_id, y AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY w DESC, y) AS q FROM votes) WHERE q = 1)
SELECT DISTINCT m.row_id, CAST(m.row_id % 5 AS BIGINT) AS fold, CAST(m.label AS BIGINT) AS label, CAST(predicted AS BIGINT) AS predicted FROM m JOIN best USING (row_id)"""
# Distances over the first n features of the order are running sums along it.
_SWEEP = _GREEDY(64).rsplit(" SELECT ", 1)[0] + """, o AS MATERIALIZED (SELECT k, chosen[k] AS feat FROM pick),
runs AS (SELECT a.row_id, b.row_id AS train_id, b.label AS y, k, round(sum(abs(a.v - b.v)) OVER (PARTITION BY a.row_id, b.row_id ORDER BY k), 12) AS d FROM m a JOIN m b ON a.feat = b.feat AND a.row_id % 5 != b.row_id % 5 JOIN o ON o.feat = a.feat),
near AS (SELECT *, row_number() OVER (PARTITION BY k, row_id ORDER BY d, train_id) AS i FROM runs WHERE k <= 50 OR k % 5 = 0 OR k = 64), votes AS (SELECT k, row_id, y, count(*) AS w FROM near WHERE i <= 2 GROUP BY ALL),
best AS (SELECT k, row_id, y FROM (SELECT *, row_number() OVER (PARTITION BY k, row_id ORDER BY w DESC, y) AS q FROM votes) WHERE q = 1),
folds AS (SELECT k, best.row_id % 5 AS fold, avg(CAST(m.label = y AS INT)) AS a FROM best JOIN m ON m.row_id = best.row_id AND m.feat = 0 GROUP BY ALL)
SELECT CAST(k AS BIGINT) AS n_features, round(avg(a), 6) AS cv_accuracy FROM folds GROUP BY k"""


@query("mr7_fold_local_selection", _LOCAL)
def _(s, d):
    return T.rounded(experiments.evaluate(_folded(s, d), 2, "cityblock", "uniform", keep=8).select("row_id", "fold", "label", "predicted"))


@query("mr9_accuracy_by_count", _SWEEP)
def _(s, d):
    rows = _folded(s, d)
    order = selection.rank(rows, "F")
    return T.rounded(experiments.sweep(rows, order, selection.sweep_counts(len(order)), 2, "cityblock", "uniform"))


# Signals

_CHANNEL = f"WITH {T.CELLS}, c AS (SELECT vec_id AS seg, p // 16 AS channel, p % 16 AS t, v AS c FROM cells)"


def _coefficients(s, d):
    return T.multichannel(s, d).select("seg", F.posexplode("signal").alias("channel", "v")).select("seg", "channel", F.posexplode("v").alias("t", "c"))


@query("sig5_sure_threshold", _CHANNEL + """, g AS (SELECT seg, channel, median(abs(c)) / 0.6745 AS sigma, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT c.seg, c.channel, sigma, n, abs(c) / sigma AS a FROM c JOIN g ON g.seg = c.seg AND g.channel = c.channel),
r AS (SELECT *, round(n - 2 * count(*) OVER w + sum(a * a) OVER w + (n - count(*) OVER w) * a * a, 9) AS risk FROM a WINDOW w AS (PARTITION BY seg, channel ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT seg, CAST(channel AS BIGINT) AS channel, round(arg_min(a, (risk, a)) * any_value(sigma), 6) AS threshold FROM r GROUP BY seg, channel""")
def _(s, d):
    return T.rounded(signals.sure_thresholds(_coefficients(s, d), ["seg", "channel"]))


@query("sig7_excess_kurtosis", _CHANNEL + " SELECT seg, CAST(channel AS BIGINT) AS channel, round(kurtosis_pop(c), 6) + 0.0 AS kurtosis FROM c GROUP BY ALL")
def _(s, d):
    return T.rounded(_coefficients(s, d).groupBy("seg", "channel").agg(F.kurtosis("c").alias("kurtosis")))


@query("sig12_frequency_axis", _CHANNEL + ", z AS (SELECT seg, channel, k, sum(c * cos(-2 * pi() * ((k * t) % 16) / 16)) AS re, sum(c * sin(-2 * pi() * ((k * t) % 16) / 16)) AS im FROM c, range(9) AS r(k) GROUP BY ALL) SELECT CAST(k AS BIGINT) AS i, round(k * 0.5 / 8, 6) AS freq, round(avg(re * re + im * im), 6) AS power FROM z GROUP BY k")
def _(s, d):
    """The frequencies of a window of 16 samples, with the mean power of all windows there."""
    sums = signals.spectrum(_coefficients(s, d).withColumnRenamed("c", "x"), ["seg", "channel"], 16)
    return T.rounded(sums.groupBy(F.col("k").alias("i")).agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power")).select("i", (F.col("i") * 0.5 / 8).alias("freq"), "power"))


@query("sig13_fourier_sums", _CHANNEL + " SELECT seg, CAST(channel AS BIGINT) AS channel, k, round(sum(c * cos(-2 * pi() * ((k * t) % 16) / 16)), 6) + 0.0 AS re, round(sum(c * sin(-2 * pi() * ((k * t) % 16) / 16)), 6) + 0.0 AS im FROM c, range(9) AS r(k) GROUP BY ALL")
def _(s, d):
    return T.rounded(signals.spectrum(_coefficients(s, d).withColumnRenamed("c", "x"), ["seg", "channel"], 16))


_RECURSIVE = _CHANNEL.replace("WITH", "WITH RECURSIVE", 1)
_SAMPLES = " SELECT seg, CAST(channel AS BIGINT) AS channel, CAST(t AS BIGINT) AS t, round(c, 6) + 0.0 AS x FROM "


def _filtered(source: str, name: str, sections, pad: int) -> str:
    """Relations that end in `name`: the channels of `source` filtered forth and back, sample by sample and section by section."""
    n, steady = 16 + 2 * pad, filters.steady_state(sections)
    y, r = f"{name}_y", f"{name}_r"
    sql = f""", {y}0 AS MATERIALIZED (SELECT seg, channel, t + {pad} AS t, c AS y FROM {source}
UNION ALL SELECT a.seg, a.channel, {pad} - b.t, 2 * a.c - b.c FROM {source} a JOIN {source} b ON a.seg = b.seg AND a.channel = b.channel AND a.t = 0 AND b.t BETWEEN 1 AND {pad}
UNION ALL SELECT a.seg, a.channel, {pad + 30} - b.t, 2 * a.c - b.c FROM {source} a JOIN {source} b ON a.seg = b.seg AND a.channel = b.channel AND a.t = 15 AND b.t BETWEEN {15 - pad} AND 14)"""
    made = 0
    for _ in range(2):
        start = made
        for (b0, b1, b2, _, a1, a2), (s0, s1) in zip(sections.tolist(), steady.tolist(), strict=True):
            sql += f""", {r}{made + 1} AS (SELECT u.seg, u.channel, u.t, {b0!r} * u.y + {s0!r} * f.y AS y, {b1!r} * u.y - {a1!r} * ({b0!r} * u.y + {s0!r} * f.y) + {s1!r} * f.y AS z0, {b2!r} * u.y - {a2!r} * ({b0!r} * u.y + {s0!r} * f.y) AS z1
FROM {y}{made} u JOIN {y}{start} f ON f.seg = u.seg AND f.channel = u.channel AND f.t = 0 WHERE u.t = 0
UNION ALL SELECT u.seg, u.channel, u.t, {b0!r} * u.y + z0, {b1!r} * u.y - {a1!r} * ({b0!r} * u.y + z0) + z1, {b2!r} * u.y - {a2!r} * ({b0!r} * u.y + z0) FROM {r}{made + 1} r JOIN {y}{made} u ON u.seg = r.seg AND u.channel = r.channel AND u.t = r.t + 1)"""
            made += 1
            sql += f", {y}{made} AS MATERIALIZED (SELECT seg, channel, t, y FROM {r}{made})"
        made += 1
        sql += f", {y}{made} AS MATERIALIZED (SELECT seg, channel, {n - 1} - t AS t, y FROM {y}{made - 1})"
    return sql + f", {name} AS MATERIALIZED (SELECT seg, channel, t - {pad} AS t, y AS c FROM {y}{made} WHERE t BETWEEN {pad} AND {pad + 15})"


#: Matrices of one wavelet step of 16 samples, from the taps: analysis with mirrored ends, and synthesis.
_TAPS = ", w(j, lo) AS (VALUES " + ", ".join(f"({j}, {x!r}::DOUBLE)" for j, x in enumerate(wavelets.COIF3.tolist())) + """),
v AS (SELECT a.j, a.lo, b.lo * CASE WHEN a.j % 2 = 1 THEN 1 ELSE -1 END AS hi FROM w a JOIN w b ON b.j = 17 - a.j),
mirrored AS (SELECT i, (2 * i + 33 - j) % 32 AS p, lo, hi FROM range(16) AS r(i), v),
apart AS MATERIALIZED (SELECT i, CASE WHEN p < 16 THEN p ELSE 31 - p END AS t, sum(lo) AS lo, sum(hi) AS hi FROM mirrored GROUP BY ALL),
together AS MATERIALIZED (SELECT i, t, lo, hi FROM range(16) AS r(i), range(16) AS q(t), v WHERE v.j = 1 + 2 * i - t)"""


def _denoised(source: str, name: str, level: int = 6) -> str:
    """Relations that end in `name`: details of each level, pulled to zero by the threshold of least estimated risk, put together again."""
    sql = f", {name}_a0 AS (SELECT seg, channel, t, c FROM {source})"
    for k in range(1, level + 1):
        a, d = f"{name}_a{k}", f"{name}_d{k}"
        sql += f""", {a} AS MATERIALIZED (SELECT seg, channel, i AS t, sum(lo * c) AS c, sum(hi * c) AS d FROM {name}_a{k - 1} JOIN apart USING (t) GROUP BY ALL),
{d}g AS (SELECT seg, channel, median(abs(d)) / 0.6745 AS sigma, count(*) AS n FROM {a} GROUP BY ALL),
{d}a AS (SELECT seg, channel, sigma, n, abs(d) / sigma AS a FROM {a} JOIN {d}g USING (seg, channel) WHERE sigma >= 1e-10),
{d}r AS (SELECT *, round(n - 2 * count(*) OVER w + sum(a * a) OVER w + (n - count(*) OVER w) * a * a, 9) AS risk FROM {d}a WINDOW w AS (PARTITION BY seg, channel ORDER BY a RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{d}t AS MATERIALIZED (SELECT seg, channel, arg_min(a, (risk, a)) * any_value(sigma) AS least FROM {d}r GROUP BY ALL),
{d} AS MATERIALIZED (SELECT seg, channel, t, sign(d) * greatest(abs(d) - coalesce(least, 0), 0) AS d FROM {a} LEFT JOIN {d}t USING (seg, channel))"""
    last = f"{name}_a{level}"
    for k in range(level, 0, -1):
        made = name if k == 1 else f"{name}_b{k - 1}"
        sql += f""", {made} AS MATERIALIZED (SELECT b.seg, b.channel, m.t, sum(m.lo * b.c + m.hi * d.d) AS c FROM {last} b JOIN {name}_d{k} d ON d.seg = b.seg AND d.channel = b.channel AND d.t = b.t JOIN together m ON m.i = b.t GROUP BY ALL)"""
        last = made
    return sql


_BAND, _LINE = filters.butterworth_bandpass(0.5, 60.0, 128.0, 4), filters.notch(50.0, 128.0)
_TWICE = _denoised("line", "once") + _denoised("once", "twice")


_ENVELOPE = _CHANNEL + """, s AS (SELECT seg, channel, k, sum(c * cos(2 * pi() * ((k * t) % 16) / 16)) AS re, -sum(c * sin(2 * pi() * ((k * t) % 16) / 16)) AS im, CASE WHEN k % 8 = 0 THEN 1 ELSE 2 END AS g FROM c, range(9) AS r(k) GROUP BY ALL),
a AS (SELECT seg, channel, t, sum(g * (re * cos(2 * pi() * ((k * t) % 16) / 16) - im * sin(2 * pi() * ((k * t) % 16) / 16))) / 16 AS re, sum(g * (re * sin(2 * pi() * ((k * t) % 16) / 16) + im * cos(2 * pi() * ((k * t) % 16) / 16))) / 16 AS im FROM s, range(16) AS r(t) GROUP BY ALL)
SELECT seg, CAST(channel AS BIGINT) AS channel, CAST(t AS BIGINT) AS t, round(sqrt(re * re + im * im), 6) AS x FROM a"""


def _signal(name: str, run: Callable[[DataFrame], DataFrame], sql: str | None = None):
    @query(name, sql)
    def _(s, d):
        out = run(T.multichannel(s, d)).select("seg", F.posexplode("signal").alias("channel", "v"))
        return T.rounded(out.select("seg", "channel", F.posexplode("v").alias("t", "x")))


_signal("sig1_bandpass", lambda r: signals.bandpass(r, 0.5, 60.0), _RECURSIVE + _filtered("c", "band", _BAND, 15) + _SAMPLES + "band")
_signal("sig2_notch", signals.notch, _RECURSIVE + _filtered("c", "line", _LINE, 9) + _SAMPLES + "line")
_signal("sig3_ocular_wavelet_filter", signals.denoise, _CHANNEL + _TAPS + _denoised("c", "once") + _SAMPLES + "once")
_signal("sig4_sure_denoise", lambda r: signals.denoise(signals.denoise(r)), _CHANNEL + _TAPS + _denoised("c", "once") + _denoised("once", "twice") + _SAMPLES + "twice")
_signal("sig6_ica_artifact_removal", signals.remove_artifacts)
_signal("sig8_mode_a_chain", signals.clean_approximately)
_signal("sig9_raw_chain", signals.clean_raw, _RECURSIVE + _filtered("c", "band", _BAND, 15) + _filtered("band", "line", _LINE, 9) + _TAPS + _TWICE + _SAMPLES + "twice")
_signal("sig10_dispatch_mode_a", lambda r: signals.preprocess(r, "A"))
_signal("sig11_hilbert_envelope", signals.envelope, _ENVELOPE)

# Decomposition


def _decomposed(s, d):
    return decompose.decompose(T.multichannel(s, d), ["seg"], 128.0)


@query("dec1_decompose")
def _(s, d):
    return T.rounded(_decomposed(s, d).select("seg", "n_modes", "error"))


@query("dec2_modes_long")
def _(s, d):
    return T.rounded(_decomposed(s, d).select("seg", F.posexplode("freqs").alias("k", "freq"), "iterations").select("seg", "k", "freq", F.get("iterations", F.col("k")).alias("iterations")))


@query("dec4_mode_count_distribution")
def _(s, d):
    return _decomposed(s, d).groupBy("n_modes").count()


@query("dec5_validate_decomposition")
def _(s, d):
    return T.rounded(decompose.validate(T.multichannel(s, d), _decomposed(s, d), ["seg"], 128.0))


@query("drv1_feature_matrix")
def _(s, d):
    return T.rounded(decompose.feature_vectors(T.multichannel(s, d), ["seg"], 128.0).select("seg", "n_modes", F.posexplode("f").alias("j", "v")))


# Artifacts

_ELECTRODES = "el(number, name, theta, radius, x, y, z) AS (VALUES " + ", ".join(f"({n}, '{a}', {', '.join(f'{v}::DOUBLE' for v in rest)})" for n, a, *rest in artifacts.ELECTRODES) + ")"
_IC = _ELECTRODES + ", wt AS (SELECT vec_id AS ic, p + 1 AS number, v AS w FROM cells WHERE p < 14)"


def _weights(s, d):
    return T.matrix(s, d).select(F.col("row_id").alias("ic"), F.posexplode(F.slice("f", 1, 14)).alias("p", "w")).select("ic", (F.col("p") + 1).alias("number"), "w")


@query("art7_electrode_table", f"WITH {T.CELLS}, {_IC} SELECT CAST(number AS BIGINT) AS number, name, round(theta, 6) AS theta, round(radius, 6) AS radius, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(avg(w), 6) + 0.0 AS weight FROM el JOIN wt USING (number) GROUP BY ALL")
def _(s, d):
    """The electrodes' places, with the mean weight of all components there."""
    mean = _weights(s, d).groupBy("number").agg(F.avg("w").alias("weight"))
    return T.rounded(artifacts.electrodes(s).join(mean, "number"))


_NEAR = "nr AS (SELECT * FROM (SELECT a.number, b.number AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d, row_number() OVER (PARTITION BY a.number ORDER BY round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)), 9), b.number) AS r FROM el a JOIN el b ON a.number != b.number WHERE a.number < 14) WHERE r <= 10)"


@query("jn4_nearest_electrodes", f"WITH {T.CELLS}, {_IC}, {_NEAR} SELECT CAST(nr.number AS BIGINT) AS number, CAST(other AS BIGINT) AS other, round(d, 6) AS d, CAST(r AS BIGINT) AS r, round(avg(abs(a.w - b.w)), 6) + 0.0 AS apart FROM nr JOIN wt a ON a.number = nr.number JOIN wt b ON b.number = nr.other AND b.ic = a.ic GROUP BY ALL")
def _(s, d):
    """Each electrode's nearest ones, with how far apart the components' weights are there."""
    near, w = artifacts.nearest(artifacts.electrodes(s)), _weights(s, d)
    both = F.broadcast(near).join(w, "number").join(w.select("ic", F.col("number").alias("other"), F.col("w").alias("w2")), ["ic", "other"])
    return T.rounded(both.groupBy("number", "other", "d", "r").agg(F.avg(F.abs(F.col("w") - F.col("w2"))).alias("apart")))


_SPATIAL = f"""WITH {T.CELLS}, {_IC}, {_NEAR}, j AS (SELECT * FROM wt JOIN el USING (number)),
flat AS (SELECT ic, avg(w) FILTER (abs(theta) < 60 AND radius > 0.40) AS mf, avg(w) FILTER (abs(theta) > 110) AS mb, var_samp(w) FILTER (abs(theta) < 60 AND radius > 0.40) - var_samp(w) FILTER (abs(theta) > 110) AS diff_var,
avg(w) FILTER (theta > -61 AND theta < -35 AND radius > 0.30) AS l, avg(w) FILTER (theta > 34 AND theta < 61 AND radius > 0.30) AS r FROM j GROUP BY ic),
ar AS (SELECT wt.ic, nr.number, avg(exp(-d) * w) AS around FROM nr JOIN wt ON wt.number = nr.other GROUP BY ALL), gd AS (SELECT ar.ic, max(abs(wt.w - around)) AS gdsf FROM ar JOIN wt ON wt.ic = ar.ic AND wt.number = ar.number GROUP BY ar.ic)"""


@query("art5_spatial_features", _SPATIAL + ' SELECT flat.ic, round(abs(mf) - abs(mb), 6) AS sad, round(abs(l - r), 6) AS sed, round(l, 6) AS "left", round(r, 6) AS "right", round(diff_var, 6) AS diff_var, round(gdsf, 6) AS gdsf FROM flat JOIN gd ON gd.ic = flat.ic')
def _(s, d):
    return T.rounded(artifacts.spatial(_weights(s, d), artifacts.electrodes(s)))


_TEMPORAL = ", ep AS (SELECT vec_id AS ic, p // 16 AS epoch, kurtosis_pop(v) AS k, var_samp(v) AS v FROM cells GROUP BY ALL), tm AS (SELECT ic, avg(k) AS kurtosis, max(v) / avg(v) AS mev FROM ep GROUP BY ic)"


def _activity(s, d):
    return _coefficients(s, d).select(F.col("seg").alias("ic"), F.col("channel").alias("epoch"), F.col("c").alias("x"))


@query("art4_temporal_features", f"WITH {T.CELLS}" + _TEMPORAL + " SELECT ic, round(kurtosis, 6) + 0.0 AS kurtosis, round(mev, 6) AS mev FROM tm")
def _(s, d):
    return T.rounded(artifacts.temporal(_activity(s, d)))


_LIMITS = {"kurtosis": 0.2, "sed": 0.05, "sad": 0.01, "gdsf": 0.25, "mev": 1.2}
_ALL = _SPATIAL + _TEMPORAL + ", ft AS (SELECT flat.ic, abs(mf) - abs(mb) AS sad, abs(l - r) AS sed, l, r, diff_var, gdsf, kurtosis, mev FROM flat JOIN gd ON gd.ic = flat.ic JOIN tm ON tm.ic = flat.ic)"


def _component_features(s, d):
    return artifacts.spatial(_weights(s, d), artifacts.electrodes(s)).join(artifacts.temporal(_activity(s, d)), "ic")


@query("art2_badness_score", _ALL + " SELECT ic, round(" + " + ".join(f"greatest(0, ({f} - {v}) / {v})" for f, v in _LIMITS.items()) + ", 6) AS badness FROM ft")
def _(s, d):
    return T.rounded(artifacts.badness(_component_features(s, d), _LIMITS))


@query("art3_artifact_classes", _ALL + """ SELECT ic, 'horizontal' AS kind FROM ft WHERE sed >= 0.05 AND l * r < 0 AND mev >= 1.2 UNION SELECT ic, 'vertical' FROM ft WHERE sad >= 0.01 AND l * r > 0 AND diff_var > 0 AND mev >= 1.2
UNION SELECT ic, 'blink' FROM ft WHERE sad >= 0.01 AND l * r > 0 AND kurtosis >= 0.2 AND diff_var > 0 UNION SELECT ic, 'discontinuity' FROM ft WHERE gdsf >= 0.25 AND mev >= 1.2""")
def _(s, d):
    return artifacts.classes(_component_features(s, d), _LIMITS)
