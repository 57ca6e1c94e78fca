"""Subject, label and condition from file names; first or preferred file of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modeloom.sources.shared import numbered


def _has(text: Column, *words: str) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def _name(path: Column) -> tuple[Column, Column, Column]:
    """Stem, parent and the whole path, in lower case."""
    file = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(file, r"\.[^.]*$", "")), F.lower(F.regexp_extract(path, r"^(.*)/[^/]*$", 1)), F.lower(path)


def parse_names(paths: DataFrame, path: str = "path") -> DataFrame:
    """(subject_id, condition, label, path) of the files whose names tell all three; of several one, a cleaned one if there is any, else the first.

    The label comes from the file's prefix, then from the folders, then from words in the name; the condition from the
    name, then from the folder; the number is the name's first."""
    stem, parent, whole = _name(F.col(path))
    label = (
        F.when(stem.startswith("nds"), "IDD").when(stem.startswith("cgs"), "TDC")
        .when(_has(whole, "idd", "nds"), "IDD").when(_has(whole, "tdc", "cgs", "control"), "TDC")
        .when(_has(stem, "intellectual", "disorder"), "IDD").when(_has(stem, "typical", "healthy"), "TDC")
    )
    condition = F.when(stem.contains("rest"), "rest").when(_has(stem, "music", "stimulus"), "music").when(parent.contains("rest"), "rest").when(parent.contains("music"), "music")
    number = F.regexp_extract(stem, r"(\d+)", 1)
    parsed = paths.select(F.col(path).alias("path"), label.alias("label"), condition.alias("condition"), number.alias("number"), (_has(whole, "clean") | stem.contains("_cd")).alias("clean"))
    parsed = parsed.filter("label IS NOT NULL AND condition IS NOT NULL AND number != ''")
    parsed = parsed.withColumn("subject_id", F.concat_ws("_", "label", F.when(F.length("number") < 3, F.lpad("number", 3, "0")).otherwise(F.col("number"))))
    # Of cleaned files the last stands, as each one replaces what came before.
    latest = Window.partitionBy("subject_id", "condition").orderBy(F.desc("clean"), F.when(F.col("clean"), F.col("path")).desc(), "path")
    return parsed.withColumn("r", F.row_number().over(latest)).filter("r = 1").select("subject_id", "condition", F.when(F.col("label") == "IDD", 1).otherwise(0).alias("label"), "path")


def parse_generic(paths: DataFrame, path: str = "path") -> DataFrame:
    """For names that tell nothing: numbered by path, label and condition from the folder or else TDC and music."""
    _, parent, _ = _name(F.col(path))
    label, at = F.when(_has(parent, "idd", "nds"), "IDD").otherwise("TDC"), F.col("__number")
    return numbered(paths.select(path), path, to="__number").select(F.concat(label, F.lit("_"), F.when(at < 1000, F.lpad(at.cast("string"), 3, "0")).otherwise(at.cast("string"))).alias("subject_id"), F.when(parent.contains("rest"), "rest").otherwise("music").alias("condition"), F.col(path).alias("path"))


def parse_members(members: DataFrame, archive: str = "archive", member: str = "member") -> DataFrame:
    """(subject_id, label, archive, member) of an archive's members; the archive's name gives the label, the first one with an id stands."""
    stem, _, _ = _name(F.col(archive))
    label = F.when(stem.contains("adhd"), 1).when(stem.contains("control"), 0)
    subject = F.regexp_replace(F.element_at(F.split(member, "/"), -1), r"\.[^.]*$", "")
    known = members.filter(F.col(member).endswith(".mat")).select(subject.alias("subject_id"), label.alias("label"), F.col(archive).alias("archive"), F.col(member).alias("member")).filter("label IS NOT NULL")
    first = Window.partitionBy("subject_id").orderBy("archive", "member")
    return known.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")
