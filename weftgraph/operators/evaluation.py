"""Evaluation of retrieval modes: contexts, judged metrics, averages, reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.operators.services import json_objects

MODES = ("vector", "graph", "hybrid")


def contexts(vector: DataFrame, graph: DataFrame, top: int = 5) -> DataFrame:
    """(question, mode, doc_id, rank) of the three modes from scored documents (question, doc_id, score) of each source.

    hybrid takes the graph's documents first, at most min(2 * top, 10), then
    the vector's others until max(1, top - those) are added.
    """
    rank = F.row_number().over(W.partitionBy("question").orderBy(F.desc("score"), "doc_id"))
    v = vector.withColumn("rank", rank)
    g = graph.withColumn("rank", rank)
    first = g.where(F.col("rank") <= min(2 * top, 10)).select("question", "doc_id", "rank")
    n = first.groupBy("question").agg(F.count("*").alias("n"))
    others = vector.join(first.select("question", "doc_id"), ["question", "doc_id"], "left_anti").withColumn("at", rank).join(n, "question", "left").na.fill(0, ["n"])
    others = others.where(F.col("at") <= F.greatest(F.lit(1), F.lit(top) - F.col("n"))).select("question", "doc_id", (F.col("n") + F.col("at")).cast("int").alias("rank"))
    named = lambda df, mode: df.select("question", F.lit(mode).alias("mode"), "doc_id", F.col("rank").cast("int").alias("rank"))
    return named(v.where(F.col("rank") <= top), "vector").unionByName(named(g.where(F.col("rank") <= top), "graph")).unionByName(named(first.unionByName(others), "hybrid"))


def retrieval_metrics(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """(mode, questions, recall, precision, mrr) of contexts against (question, doc_id) that are relevant; a question without context counts 0."""
    modes = found.sparkSession.createDataFrame([(m,) for m in MODES], "mode string")
    size = relevant.groupBy("question").agg(F.count("*").alias("size")).join(F.broadcast(modes), F.lit(True))
    hits = found.join(relevant.select("question", "doc_id").withColumn("hit", F.lit(1)), ["question", "doc_id"], "left")
    hits = hits.groupBy("question", "mode").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("n"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    each = size.join(hits, ["question", "mode"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.groupBy("mode").agg(F.count("*").alias("questions"), F.round(F.avg(zero(F.col("hits") / F.col("size"))), 4).alias("recall"), F.round(F.avg(zero(F.col("hits") / F.col("n"))), 4).alias("precision"), F.round(F.avg(zero(1 / F.col("first"))), 4).alias("mrr"))


def judged(answer: str, context: list[str], verdicts: dict[str, str]) -> dict[str, float]:
    """faithfulness, relevance and recall from a judge's three answers in JSON; fixed values where one can't be read.

    Without context faithfulness and recall are 0; without an answer, or with
    one that says there is nothing, faithfulness and relevance are.
    """
    silent = not answer or C.NOTHING_FOUND in answer

    def share(kind: str, items: str, field: str, empty: float, fallback: float) -> float:
        try:
            rows = json.loads(re.search(r"(?s)\{.*\}", verdicts[kind])[0]).get(items, [])
            return sum(r.get(field, "NO") == "YES" for r in rows) / len(rows) if rows else empty
        except (AttributeError, KeyError, TypeError, ValueError):
            return fallback

    def rating() -> float:
        try:
            return float((json_objects(verdicts["relevance"]) or [None])[0].get("score", 8)) / 10
        except (AttributeError, KeyError, TypeError, ValueError):
            return 0.7

    return {
        "faithfulness": round(0.0 if silent or not context else share("faithfulness", "statements", "supported", 1.0, 0.8), 2),
        "relevance": round(0.0 if silent else rating(), 2),
        "recall": round(share("recall", "core_facts", "covered", 0.0, 0.6) if context else 0.0, 2),
    }


def averages(scores: DataFrame, metrics: tuple[str, ...] = ("faithfulness", "relevance", "recall")) -> DataFrame:
    """(mode, questions, metrics, best): means by mode; best marks the mode with the greatest sum of them, ties to the first name."""
    out = scores.groupBy("mode").agg(F.count("*").alias("questions"), *[F.round(F.avg(m), 4).alias(m) for m in metrics])
    total = sum((F.col(m) for m in metrics), F.lit(0.0))
    first = F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc(total), "mode"))  # a row per mode
    return out.withColumn("best", first == 1)


def report(table: DataFrame, path: str) -> str:
    """Write a (small) table of averages as CSV beside `path`, and return it as a Markdown table."""
    rows = table.orderBy(table.columns[0]).limit(1000)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "-|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.collect())])
