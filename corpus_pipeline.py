"""A training corpus from the documents table, stage by stage.

Each stage gets what its predecessor kept as `docs` and returns a DataFrame;
all but the last return the columns of documents. SQL cannot express the
stages together (the first is a trained classifier), so ORACLE_SQL is None and
tests/llm compares the stages with plain versions.

Rows are told apart by all their columns, never by doc_id alone: a rejected
row takes no other row of its id with it, and rows that are equal in every
column leave one at the exact stage. Null, empty and blank texts are documents
like others (they are exact copies of each other); extra columns pass through
unchanged whatever their names, but for names that begin with two underscores,
and `repetition` at the mixing stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.decontam import decontaminate
from weftgraph.llm.exactdup import drop_exact
from weftgraph.llm.mixing import mixed_corpus
from weftgraph.llm.neardup import drop_near
from weftgraph.llm.toxicity import drop_toxic, toxicity_labels
from weftgraph.session import discard, materialise, temporary

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject.

    It is fitted on the labelled rows among docs. Null and empty texts are
    scored by the bias, long texts whole; equal texts fare alike.
    """
    with temporary(spark):
        return drop_toxic(docs, toxicity_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: most code points, then smallest id (null last), then row hash."""
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (smallest id, null last, then row hash) of each component of texts whose five-word shingles have Jaccard 0.8 or more."""
    return drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and blank texts and items match nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's share asks for, numbered by `repetition`; null sources are one source."""
    return mixed_corpus(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read back; a stage's input goes when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary(spark) as kept:
            out = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(out)
        if hasattr(docs, "_weftgraph_path"):
            discard(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
