"""The corpus pipeline: quality rules, toxicity, near duplicates, benchmark leaks, packing.

Each stage works on all that its predecessor kept, and its result is written as Parquet and read again before the
next one. All but the last return the columns of `documents`. Null ids, empty texts, repeated rows, empty tables and
extra columns are handled as the docstrings of the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, line_rules, packing, simhash, toxicity
from factorloom.llm.common import table
from factorloom.plans.runtime import stage

#: SQL cannot express the stages after the first; tests compare each with a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or are depleted, and takes frequent lines out of the others, whose
    n_chars is counted anew."""
    kept = line_rules.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic; the labels that are not held out teach the score."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies: all pairs with a
    similarity of 0.8 or more over five-word shingles are links."""
    return simhash.first_of_each(docs, width=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within the edit budget."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row a piece."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("toxicity", drop_toxic), ("near_duplicates", near_duplicates),
          ("decontamination", decontaminated), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; every result but the last is written to the shared folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
