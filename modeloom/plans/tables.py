"""The test tables read as recordings, windows, modes, matrices and predictions; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.operators import segments

SIZE, STEP, FS = 15, 7, 1.0


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six decimals, and no negative zero: what two engines that add up in different orders agree on."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six decimals, whole numbers to one width."""
    kinds = {"double": r6, "float": r6, "int": lambda c: F.col(c).cast("long"), "smallint": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long")}
    return frame.select(*[(kinds[k](c) if k in kinds else F.col(c)).alias(c) for c, k in frame.dtypes])


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, t, x) of events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(F.col("user_id").alias("subject"), (F.row_number().over(order) - 1).alias("t"), F.col("value").alias("x"))


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, w, i, x)."""
    return segments.long_windows(samples(spark, folder), SIZE, STEP, ["subject"])


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, signal) with one channel."""
    rows = samples(spark, folder).groupBy("subject").agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("r"))
    return rows.select("subject", F.array(F.transform("r", lambda s: s["x"])).alias("signal"))


def multichannel(spark: SparkSession, folder: str) -> DataFrame:
    """(seg, signal) of embeddings as 4 channels of 16 samples."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("seg"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(v, c * 16 + 1, 16)).alias("signal"))


def modes(spark: SparkSession, folder: str) -> DataFrame:
    """(seg, k, channel, t, x): the values of an embedding as 2 modes of 2 channels of 16 samples."""
    flat = table(spark, folder, "embeddings").select(F.col("vec_id").alias("seg"), F.posexplode("embedding").alias("p", "v"))
    p = F.col("p")
    return flat.select("seg", F.floor(p / 32).alias("k"), F.pmod(F.floor(p / 16), F.lit(2)).alias("channel"), F.pmod(p, F.lit(16)).alias("t"), F.col("v").cast("double").alias("x"))


def matrix(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, label, grp, f)."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).cast("int").alias("label"), (F.col("vec_id") % 14).alias("grp"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, label, predicted, grp, fold) from labels: quality as truth, a rule on the id as prediction."""
    rows = table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"), F.when(F.col("doc_id") % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("predicted"), (F.col("doc_id") % 23).alias("grp"), (F.col("doc_id") % 10).alias("fold"))
    return rows


SAMPLES = "samples AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x FROM events)"
WINDOWS = f"""{SAMPLES},
lens AS (SELECT subject, count(*) AS n FROM samples GROUP BY subject),
w0 AS (SELECT subject, unnest(range(CASE WHEN n < 15 THEN 0 ELSE greatest(1, CAST(floor((n - 16) / 7.0) AS BIGINT) + 1) END)) AS w FROM lens),
win AS (SELECT s.subject, w0.w, s.t - w0.w * 7 AS i, s.x FROM w0 JOIN samples s ON s.subject = w0.subject AND s.t >= w0.w * 7 AND s.t < w0.w * 7 + 15)"""
CELLS = "cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS v, label FROM embeddings)"
MODES = CELLS + ", modes AS (SELECT vec_id AS seg, p // 32 AS k, (p // 16) % 2 AS channel, p % 16 AS t, v AS x FROM cells)"
MATRIX = CELLS + ", m AS (SELECT vec_id AS row_id, label % 2 AS label, vec_id % 14 AS grp, p AS feat, v FROM cells)"
PREDICTIONS = "pred AS (SELECT doc_id AS row_id, quality AS label, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS predicted, doc_id % 23 AS grp, doc_id % 10 AS fold FROM labels)"


def montage(spark: SparkSession, folder: str, channels: int = 14, windows: int = 8) -> DataFrame:
    """(subject, signal): embeddings as `channels` channels of recordings of about `windows` windows of 64 samples each. Rows go
    to channels and windows by their id; what the last window lacks is zero."""
    rows = table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / (channels * windows)).alias("subject"), (F.floor(F.col("vec_id") / channels) % windows).alias("w"), (F.col("vec_id") % channels).alias("c"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    )
    held = rows.groupBy("subject").agg(F.map_from_entries(F.collect_list(F.struct((F.col("w") * channels + F.col("c")).alias("at"), "v"))).alias("held"), F.max("w").alias("last"))
    zeros = F.array_repeat(F.lit(0.0), 64)
    channel = lambda c: F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), "last"), lambda w: F.coalesce(F.try_element_at("held", w * channels + c), zeros)))
    return held.select("subject", F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), channel).alias("signal"))


MONTAGE = CELLS + """, cut AS (SELECT vec_id // 112 AS subject, vec_id // 14 % 8 AS w, vec_id % 14 AS channel, p, v FROM cells), lens AS (SELECT subject, max(w) AS last FROM cut GROUP BY subject),
montage AS (SELECT subject, channel, w * 64 + p AS t, coalesce(v, 0.0) AS x FROM (SELECT * FROM (SELECT subject, unnest(range(last + 1)) AS w FROM lens), range(14) c(channel), range(64) r(p)) LEFT JOIN cut USING (subject, w, channel, p))"""
