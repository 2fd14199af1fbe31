"""Corpus pipeline: five stages over the documents, each written as Parquet and read again.

Every stage returns the columns of documents, but for the last, keeps extra columns, and gives an empty
table for an empty one. doc_id is a key: rows without one pass stages 2 to 4 unless their text decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import decontam, langid, linededup, pieces, simhash
from riskframe.llm.common import read, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; null and letterless texts go."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites stay in their first document only; repeated rows count as one document."""
    return linededup.clean_lines(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates: that of the smallest doc_id; ties stay together."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items; null texts hold none."""
    return decontam.keep_uncontaminated(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids and round_trip of the documents that remain."""
    return pieces.encode_documents(docs)


STAGES = [("language", language), ("lines", lines), ("copies", copies), ("benchmark", benchmark),
          ("tokens", tokens)]

#: Profiles, components and segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
