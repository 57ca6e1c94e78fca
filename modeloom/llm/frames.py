"""What the text operators share on the DataFrame side."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over `value`, which is worked out once however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def plain_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows with the same id and text are one document, rows with the same id and another text are not."""
    return F.struct(doc_id.alias("id"), F.xxhash64(plain_text(text)).alias("h"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir, or a folder of our own where none is set and all run on this machine (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written to the checkpoint folder as a table and read again; Spark then frees the shuffle files of its making."""
    spark, free = frame.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    ensure_checkpoint_dir(spark)
    folder, before = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}", spark.conf.get(free, "false")
    try:
        spark.conf.set(free, "true")
        frame.select("*").write.parquet(folder)
    finally:
        spark.conf.set(free, before)
    return spark.read.schema(frame.schema).parquet(folder)


def join_uneven(rows: DataFrame, named: DataFrame, key: str, total: int, most: int = 1 << 16, least: int = 4096) -> DataFrame:
    """`rows` with what `named` says of their key, of which it has one row each, with the number of rows as `weight`. Keys of
    more than `least` rows and 1 in `most` of all `total`, so fewer than `most`, are broadcast and their rows stay where they
    are; the others meet in a shuffle."""
    hot = F.col("weight") > max(least, total // most)
    many = F.broadcast(named.filter(hot))
    return rows.join(many, key).unionByName(rows.join(many.select(key), key, "left_anti").join(named.filter(~hot), key))


def head(frame: DataFrame, rows: int, text: str, chars: int) -> DataFrame:
    """The first rows that Spark finds, each text up to so many characters, as a table of its own: for fits and estimates
    that take a bounded sample. Spark reads partitions one after the other until there are enough; a limit inside a plan
    would take as many rows from each."""
    found = frame.withColumn(text, F.substring(F.col(text), 1, chars)).limit(rows).collect()
    return frame.sparkSession.createDataFrame(found, frame.schema)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds what a Python worker gets at once; whole texts can be long, so the session's default is too much."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bytes_of(frame: DataFrame) -> int:
    """What the tables that a frame reads have in bytes, whichever columns it takes; 0 where Spark doesn't know."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def parts(frame: DataFrame, each: int) -> int:
    """So many parts that one has about `each` bytes, and no fewer than Spark's shuffles have."""
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(bytes_of(frame) / each))
