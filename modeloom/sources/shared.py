"""Folders that all executors see, for tables that a job writes on its way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's spark.checkpoint.dir, or in one of our own where none is set and all run on this machine (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def written(frame: DataFrame) -> DataFrame:
    """The frame, written and read again, so that what follows starts from the table."""
    spark, folder = frame.sparkSession, shared_folder(frame.sparkSession)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def numbered(frame: DataFrame, *order: str, to: str = "number") -> DataFrame:
    """The frame with `to`, from 0 on in an order. Ranges of the order are written and numbered apart; what lies before a range
    comes from a table of ranges, so no task gets all rows."""
    ranges = frame.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(ranges.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(F.col("__range").cast("long"), 33)))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return held.join(F.broadcast(offsets), "__range").withColumn(to, F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")
