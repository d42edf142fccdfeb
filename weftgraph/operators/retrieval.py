"""Chunk choice under a budget, context assembly, evaluation figures."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C


def chunk_score(cos: Column, q_hits: Column, e_hits: Column, text: Column) -> Column:
    """Best cosine + 0.4 per query hit + 0.1 per entity hit + 0.25 for an enumeration with any hit."""
    bonus = F.when(((q_hits > 0) | (e_hits > 0)) & text.rlike(C.ENUMERATION), F.lit(0.25)).otherwise(F.lit(0.0))
    return cos + q_hits * F.lit(0.4) + e_hits * F.lit(0.10) + bonus


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text."""
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))


def budget(rows: DataFrame, owner: list[str], order: list[Column], length: str, most: int) -> DataFrame:
    """Rows in order while the running length stays within the budget: lengths are not negative, so stopping equals a prefix."""
    run = F.sum(length).over(W.partitionBy(*owner).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("total", run).where(F.col("total") <= most)


def with_neighbours(rows: DataFrame, owner: str, idx: str, hit: str) -> DataFrame:
    """Rows that are hits or stand next to one."""
    w = W.partitionBy(owner).orderBy(idx)
    near = F.coalesce(F.lag(hit).over(w), F.lit(False)) | F.coalesce(F.lead(hit).over(w), F.lit(False)) | F.col(hit)
    return rows.withColumn("near", near).where("near").drop("near")


def sampled(rows: DataFrame, owner: str, idx: str, cap: int = 200) -> DataFrame:
    """Every step-th row, step = rows // cap (at least 1), and the first `cap` of them: this operator is a sample."""
    n = F.count("*").over(W.partitionBy(owner))
    some = rows.withColumn("step", F.greatest(F.lit(1), F.floor(n / cap))).where(F.col(idx) % F.col("step") == 0)
    return some.withColumn("rn", F.row_number().over(W.partitionBy(owner).orderBy(idx))).where(F.col("rn") <= cap).drop("rn", "step")


def recent_turns(messages: DataFrame, turns: int = 4) -> DataFrame:
    """The last 2 * turns messages of each conversation."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"))
    return messages.withColumn("back", F.row_number().over(order)).where(F.col("back") <= 2 * turns)


def prompt_budget(rows: DataFrame, owner: str, total: int = 7500, least: int = 500) -> DataFrame:
    """Characters for each context: max(least, total // contexts)."""
    return rows.withColumn("budget", F.greatest(F.lit(least), F.floor(F.lit(total) / F.count("*").over(W.partitionBy(owner)))))


def hybrid(graph_docs: DataFrame, similar: DataFrame, top_k: int = 5) -> DataFrame:
    """(doc_id, origin, rank): graph documents up to min(2k, 10), then similar ones up to max(1, k - those)."""
    g = graph_docs.orderBy("rank").limit(min(2 * top_k, 10)).select("doc_id", F.lit("graph").alias("origin"), "rank")
    n = g.agg(F.count("*").alias("n"))
    s = similar.join(g, "doc_id", "left_anti").orderBy(F.desc("score"), "doc_id").limit(max(1, top_k))  # few rows: the window is one task
    s = s.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), "doc_id")))
    s = s.join(F.broadcast(n), F.lit(True)).where(F.col("rank") <= F.greatest(F.lit(1), F.lit(top_k) - F.col("n"))).select("doc_id", F.lit("similar").alias("origin"), "rank")
    return g.unionByName(s)


def cite(fact: Column, title: Column, confidence: Column) -> Column:
    """The fact with its source and, above 1, its confidence."""
    titled = F.concat(fact, F.lit("[來源：《"), title, F.lit("》"), F.when(confidence > 1, F.concat(F.lit("，信心 "), confidence.cast("string"))).otherwise(F.lit("")), F.lit("]"))
    plain = F.when(confidence > 1, F.concat(fact, F.lit("[信心 "), confidence.cast("string"), F.lit("]"))).otherwise(fact)
    return F.when(F.coalesce(title, F.lit("")) != "", titled).otherwise(plain)


def pick_chunks(docs: DataFrame, id_col: str, text_col: str, queries: list[tuple[str, list[float]]], entities: list[str], most: int, embed, target: int = 400) -> DataFrame:
    """(id, snippet): chunks of each document by query hits and score, within `most` characters.

    queries: (name, vector); embed: column of texts to column of vectors. Hits
    rank before scores, so chunks behind others that fill the budget by their
    hits alone can't be taken and aren't embedded; all others are. Documents
    of one chunk, or whose best chunk is too long, give their beginning.
    """
    from weftgraph.functions import text as X
    from weftgraph.functions.vectors import cosine_of, dot, norm

    names = [n for n, _ in queries if len(n.strip()) > 1]
    clean = docs.select(F.col(id_col), X.nfkc(F.col(text_col)).alias("content"))
    # exploded from an array of one, so that no filter on the parts packs the text again
    parts = X.pack(F.col("paragraphs"), target)
    packed = clean.select(id_col, F.explode(F.array(X.paragraphs(F.col("content"), target))).alias("paragraphs")).select(id_col, F.explode(F.array(parts)).alias("parts"))
    many = packed.where(F.size("parts") > 1).select(id_col, F.posexplode("parts").alias("idx", "chunk"))
    many = many.withColumn("q_hits", hits(F.col("chunk"), names)).withColumn("n_chars", F.length("chunk"))
    before = F.sum("n_chars").over(W.partitionBy(id_col).orderBy(-F.col("q_hits")).rangeBetween(W.unboundedPreceding, -1))  # of chunks with more hits
    many = many.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= most)
    vector = embed(F.substring("chunk", 1, 512))
    lengths = [math.sqrt(reduce(lambda s, x: s + float(x) * float(x), q, 0.0)) for _, q in queries]
    best = F.array_max(F.array(*[cosine_of(dot(F.col("v"), F.array(*[F.lit(float(x)) for x in q])), F.col("v_norm"), F.lit(n)) for (_, q), n in zip(queries, lengths, strict=True)]))
    scored = many.withColumn("v", vector).withColumn("v_norm", norm(F.col("v"))).withColumn("score", chunk_score(best, F.col("q_hits"), hits(F.col("chunk"), entities), F.col("chunk")))
    taken = budget(scored, [id_col], [F.desc("q_hits"), F.desc("score"), F.col("idx")], "n_chars", most)
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("q_hits"), F.desc("score"), "idx"))
    joined = taken.withColumn("rank", rank).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk"))).alias("c"))
    joined = joined.select(id_col, F.array_join(F.transform("c", lambda x: x["chunk"]), "\n\n---\n\n").alias("picked"))
    return clean.join(joined, id_col, "left").select(id_col, F.coalesce("picked", F.substring("content", 1, most)).alias("snippet"))


def entity_names(fact: Column) -> Column:
    """Subject and object of a rendered fact."""
    ends = F.array(*[F.trim(F.regexp_extract(fact, C.FACT_ENDS, i)) for i in (1, 2)])
    return F.filter(ends, lambda x: x != "")


def sentence_of(fact: Column) -> Column:
    """A rendered fact as a sentence by its label's template, else `subject label object。`; null for chains and other texts."""
    s, label, o = (F.trim(F.regexp_extract(fact, C.FACT_PARTS, i)) for i in (1, 2, 3))
    out = F.concat(s, F.lit(" "), label, F.lit(" "), o, F.lit("。"))
    for name, template in C.SENTENCES.items():
        parts = [{"{s}": s, "{o}": o}.get(p, F.lit(p)) for p in re.split(r"(\{[so]\})", template) if p]
        out = F.when(label == name, F.concat(*parts)).otherwise(out)
    return F.when(fact.rlike(C.FACT_PARTS) & ~fact.startswith("[推理鏈]"), out)
