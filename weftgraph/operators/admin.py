"""Housekeeping of the store: clearing, counters, namespaces, reports, identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C


def effective(implicit: DataFrame, key: tuple[str, ...] = ("owner_id", "name")) -> DataFrame:
    """Effective links: what the implicit ones say, one per key with the greatest weights; links without implicit row vanish."""
    weights = [c for c in implicit.columns if c not in key]
    return implicit.groupBy(*key).agg(*[F.max(c).alias(c) for c in weights])


def clear_relations(edges: DataFrame, kg: int) -> DataFrame:
    """edges without those of one graph."""
    return edges.where(~F.col("kg_id").eqNullSafe(F.lit(kg)))


def clear_entities(entities: DataFrame, edges: DataFrame, kg: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without one graph's entities and, as nodes take their edges along, its edges."""
    return clear_relations(entities, kg), clear_relations(edges, kg)


def delete_graph(kgs: DataFrame, links: DataFrame, edges: DataFrame, kg: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Graphs, document links and edges after a graph is deleted."""
    return clear_relations(kgs, kg), clear_relations(links, kg), clear_relations(edges, kg)


def with_counters(kgs: DataFrame, links: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """kgs with document_count, entity_count and relation_count from the tables themselves, so no counter can fall below 0 or drift."""
    out = kgs
    for df, name in ((links.distinct(), "document_count"), (entities, "entity_count"), (edges, "relation_count")):
        out = out.join(df.groupBy("kg_id").agg(F.count("*").alias(name)), "kg_id", "left").na.fill(0, [name])
    return out


def without_orphans(entities: DataFrame, edges: DataFrame, most: int = C.ORPHANS_AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """(entities that stay, entities deleted): nodes without edges go, at most `most` in a call, in the order of graph and name."""
    ends = edges.select("kg_id", F.explode(F.array("subject", "object")).alias("name")).distinct()
    gone = entities.join(ends, ["kg_id", "name"], "left_anti").orderBy("kg_id", "name").limit(most)
    return entities.join(gone.select("kg_id", "name"), ["kg_id", "name"], "left_anti"), gone


def delete_chunks(chunks: DataFrame, gone: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(chunks that stay, deleted chunks by key) for the documents or graphs in gone (key)."""
    keys = gone.select(key).distinct()
    return chunks.join(keys, key, "left_anti"), chunks.join(keys, key, "left_semi").groupBy(key).agg(F.count("*").alias("deleted"))


def namespaced(facts: DataFrame, instance: str, kb: Column) -> DataFrame:
    """Remote facts (subject, rel_type, object, source_doc_id, confidence) as edges of the local graph `instance::kb`, one per key."""
    rows = facts.select(F.concat(F.lit(f"{instance}::"), kb.cast("string")).alias("kg_id"), "subject", "rel_type", "object", "source_doc_id", "confidence")
    return rows.groupBy("kg_id", "subject", "rel_type", "object", "source_doc_id").agg(F.max("confidence").alias("confidence"))


def write_graph_vectors(concepts: DataFrame, vectors: DataFrame) -> DataFrame:
    """concepts (name, ...) with g_vector set from vectors (name, vector); others keep theirs, or none."""
    old = F.col("g_vector") if "g_vector" in concepts.columns else F.lit(None)
    joined = concepts.join(vectors.select("name", F.col("vector").alias("__new")), "name", "left")
    return joined.withColumn("g_vector", F.coalesce("__new", old)).drop("__new")


def communities_table(old: DataFrame | None, found: DataFrame) -> DataFrame:
    """(kg_id, community, node) after a rebuild: the graphs in `found` are cleared and replaced, others stay."""
    if old is None:
        return found
    return old.join(found.select("kg_id").distinct(), "kg_id", "left_anti").unionByName(found)


def top_communities(table: DataFrame, top: int = 5) -> DataFrame:
    """(kg_id, community, size, rank) of each graph's largest communities."""
    sizes = table.groupBy("kg_id", "community").agg(F.count("*").alias("size"), F.min("node").alias("first"))
    rank = F.row_number().over(W.partitionBy("kg_id").orderBy(F.desc("size"), "first"))
    return sizes.withColumn("rank", rank).where(F.col("rank") <= top).drop("first")


def ingest_summary(results: DataFrame, warn: float = 20.0) -> DataFrame:
    """(total, ok, fail, fail_percent, warning) of rows (ok); the warning is set from `warn` percent on."""
    out = results.agg(F.count("*").alias("total"), F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("fail"))
    percent = F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.col("fail") / F.col("total"), 2))
    return out.withColumn("fail_percent", percent).withColumn("warning", F.col("fail_percent") >= warn)


def escape_terms(terms: list[str]) -> str:
    """An OR query of prefixes for a full-text index, special characters escaped."""
    return " OR ".join(re.sub(C.QUERY_SPECIAL, r"\\\g<0>", t) + "*" for t in terms)


def row_id(*key: Column) -> Column:
    """An identifier in the form of a UUID that is the same for the same key."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in key]), 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def as_documents(rows: DataFrame) -> DataFrame:
    """Stored rows as documents: missing titles and texts empty, flags false, times null."""
    have = set(rows.columns)
    column = lambda c, kind, default: (F.coalesce(F.col(c).cast(kind), F.lit(default)) if c in have else F.lit(default).cast(kind)).alias(c)
    return rows.select("doc_id", column("title", "string", ""), column("content", "string", ""), column("file_path", "string", None), column("is_processed", "boolean", False))


def checked(kind: str, **fields):
    """Fields of a request within its bounds (lengths of texts, values of numbers); absent ones take their defaults, others are errors."""
    out = {}
    for name, (low, high, default) in C.REQUESTS[kind].items():
        value = fields.pop(name, default)
        if value is None and default is None and low > 0:
            raise ValueError(f"{name} is missing")
        size = len(value) if isinstance(value, str | list) else value
        if size is not None and not low <= size <= high:
            raise ValueError(f"{name} must be between {low} and {high}, not {size}")
        out[name] = value
    if fields:
        raise ValueError(f"unknown fields {sorted(fields)}")
    return out
