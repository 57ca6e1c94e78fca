"""Settings files: YAML, where the library for it is there, or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:
    yaml = None


def load(spark: SparkSession, path: str) -> dict:
    """The settings of a file or of all files of a folder, later names first come; {} if there are none."""
    out: dict = {}
    for row in spark.read.text(path, wholetext=True).orderBy("value").collect():
        out |= (yaml.safe_load(row["value"]) if yaml else json.loads(row["value"])) or {}
    return out


def flat(settings: dict, before: str = "") -> list[tuple[str, str]]:
    """Names with dots, and values as JSON."""
    out = []
    for name, value in settings.items():
        out += flat(value, f"{before}{name}.") if isinstance(value, dict) else [(f"{before}{name}", json.dumps(value))]
    return out


def as_rows(spark: SparkSession, settings: dict) -> DataFrame:
    return spark.createDataFrame(flat(settings), "name string, value string")
