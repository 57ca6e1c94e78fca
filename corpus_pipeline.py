"""From raw documents to encoded training text, one stage after the other.

Nulls and odd inputs: documents with a null or empty text fail the first stage's base rule and go; a null doc_id, repeated
ids and extra columns are kept through all stages; rows with equal id and text are one document to the later stages, of
which one stays; texts of any length are worked on whole; ties are broken by id, then by the text's hash; an empty table
gives an empty result, with the columns that the last stage adds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modeloom.llm import decontaminate, jaccard_join, line_dedup, pieces, quality_rules
from modeloom.llm.frames import cut, table

#: The stages by similarity, latent vectors and pieces have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.apply_rules(docs).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the runs of lines, of 50 words or more, that stand earlier."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard_join.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their pieces, and the text that these decode to."""
    return pieces.decode(pieces.encode(docs))


STAGES = [("quality rules", rules), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmarks), ("SentencePiece encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
