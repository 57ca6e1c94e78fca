"""Caches, tables and bundles that runs leave behind."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(settings: dict[str, Column]) -> Column:
    """A digest of all settings that shape a result, by name."""
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{k}="), settings[k].cast("string")) for k in sorted(settings)]), 256)


def write_cache(frame: DataFrame, folder: str, mark: str, by: tuple[str, ...] = ()) -> None:
    """Parquet with the fingerprint of its settings in a column."""
    frame.withColumn("fingerprint", F.lit(mark)).withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").partitionBy(*by).parquet(folder)


def read_cache(spark: SparkSession, folder: str, mark: str) -> DataFrame | None:
    """The cached frame, or None if there is none, it has no rows, or it was made with other settings."""
    try:
        found = spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    if "fingerprint" not in found.columns or found.filter(F.col("fingerprint") != mark).limit(1).count() or not found.limit(1).count():
        return None
    return found.drop("fingerprint", "saved_at")


def write_table(frame: DataFrame, folder: str) -> None:
    """CSV with a header; an empty frame leaves no file."""
    if frame.limit(1).count():
        frame.write.mode("overwrite").option("header", True).csv(folder)


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(folder)


def write_bundle(frame: DataFrame, folder: str) -> None:
    """Each row as a JSON document."""
    frame.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(folder)


def read_bundles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All documents that fit the schema; others are skipped."""
    found = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(folder)
    return found.filter("_bad IS NULL").drop("_bad")


def merge_sections(frame: DataFrame, folder: str, section: str = "section") -> None:
    """Replaces the sections that the frame has and leaves the others."""
    spark, name = frame.sparkSession, "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "dynamic")
        frame.write.mode("overwrite").partitionBy(section).parquet(folder)
    finally:
        spark.conf.set(name, before)


def numeric_columns(frame: DataFrame) -> list[str]:
    return [c for c, kind in frame.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def markdown(rows: DataFrame, columns: list[str], decimals: int = 4) -> DataFrame:
    """`rows` with `line`: the columns as a line of a Markdown table, doubles with so many decimals."""
    kinds = dict(rows.dtypes)
    shown = [F.format_string(f"%.{decimals}f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    return rows.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")))
