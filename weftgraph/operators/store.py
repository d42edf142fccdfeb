"""Mutations as functions from old table and change to new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

EDGE_KEY = ("kg_id", "subject", "rel_type", "object", "source_doc_id")


def upsert(base: DataFrame, delta: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """base with delta's rows merged on key: delta's non-null values win, but base's in `keep`; new keys are added."""
    b, d = base.alias("b"), delta.alias("d")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    joined = b.join(d, on, "full_outer")

    def value(c: str) -> Column:
        if c not in delta.columns:
            return F.col(f"b.{c}")
        old, new = F.col(f"b.{c}"), F.col(f"d.{c}")
        return F.coalesce(old, new) if c in keep or c in key else F.coalesce(new, old)

    return joined.select(*[value(c).alias(c) for c in base.columns])


def merge_triples(rows: DataFrame) -> DataFrame:
    """Edges of triple rows (kg_id, subject, rel_type, object, source_doc_id, verb, chunk_id, seq, ts).

    confidence counts the rows of a key, the last row's verb stays, times are
    the first and (for repeats) the last, chunk ids are distinct in the order
    of their last appearance; empty chunk ids add nothing.
    """
    last = rows.groupBy(*EDGE_KEY, "chunk_id").agg(F.max("seq").alias("last"), F.count("*").alias("n"), F.max_by("verb", "seq").alias("verb"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    ids = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("chunk_id"), F.lit("")) != "", F.struct("last", "chunk_id"))))
    out = last.groupBy(*EDGE_KEY).agg(F.sum("n").alias("confidence"), F.max_by("verb", "last").alias("verb"), F.min("lo").alias("created_at"), F.max("hi").alias("hi"), ids.alias("ids"))
    return out.select(*EDGE_KEY, "verb", "confidence", "created_at", F.when(F.col("confidence") > 1, F.col("hi")).alias("updated_at"), F.transform("ids", lambda x: x["chunk_id"]).alias("source_chunk_ids"))


def last_positions(lists: Column) -> Column:
    """One list of the distinct values of a list of lists, each at its last position; empty values add nothing."""
    flat = F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.reverse(F.array_distinct(F.reverse(flat)))


def merge_generations(rows: DataFrame) -> DataFrame:
    """Edges (the key, verb, confidence, created_at, updated_at and, where given, source_chunk_ids) of several generations `gen`, each with a key at most once.

    Counters add up, the last generation's verb stays (an absent one changes
    nothing), first creation and last update stay; chunk ids are distinct in
    the order of their last generation and place.
    """
    values = [F.sum("confidence").alias("confidence"), F.max_by("verb", F.when(F.col("verb").isNotNull(), F.col("gen"))).alias("verb"), F.min("created_at").alias("created_at"), F.max(F.coalesce("updated_at", "created_at")).alias("hi"), F.count("*").alias("n")]
    chunks = "source_chunk_ids" in rows.columns
    if chunks:  # a key has one row in each generation, and compaction bounds those
        values.append(F.array_sort(F.collect_list(F.struct("gen", "source_chunk_ids"))).alias("ids"))
    out = rows.groupBy(*EDGE_KEY).agg(*values)
    updated = F.when((F.col("n") > 1) | (F.col("confidence") > 1), F.col("hi")).alias("updated_at")
    return out.select(*EDGE_KEY, "verb", "confidence", "created_at", updated, *([last_positions(F.col("ids.source_chunk_ids")).alias("source_chunk_ids")] if chunks else []))


def merge_edges(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Both edge tables as one by `merge_generations`; chunk ids are kept where both have them."""
    both = [c for c in (*EDGE_KEY, "verb", "confidence", "created_at", "updated_at", "source_chunk_ids") if c in base.columns and c in delta.columns]
    return merge_generations(base.select(*both).withColumn("gen", F.lit(0)).unionByName(delta.select(*both).withColumn("gen", F.lit(1))))


def latest_rows(key: tuple[str, ...], group: tuple[str, ...] = ()):
    """A merge that keeps the rows of the last generation of each key; with `group`, all rows of the key's last generation."""

    def merge(rows: DataFrame) -> DataFrame:
        last = W.partitionBy(*(group or key))
        return rows.withColumn("last", F.max("gen").over(last)).where("gen = last").drop("last")

    return merge


def retype(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """edges with relations of `changes` (verb, rel_type, new_type); where the new edge exists, confidences add up."""
    moved = edges.join(F.broadcast(changes), ["verb", "rel_type"], "left") if changes.count() <= 10_000 else edges.join(changes, ["verb", "rel_type"], "left")
    moved = moved.withColumn("rel_type", F.coalesce("new_type", "rel_type"))
    return moved.groupBy(*EDGE_KEY).agg(F.sum("confidence").alias("confidence"), F.min("created_at").alias("created_at"))


def get_or_create(concepts: DataFrame, new: DataFrame) -> DataFrame:
    """concepts and those of new whose (name, domain) is not there yet."""
    return concepts.unionByName(new.dropDuplicates(["name", "domain"]).join(concepts, ["name", "domain"], "left_anti").select(*concepts.columns))


def latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The last row of each key in the order of `by`."""
    order = W.partitionBy(*key).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Deletion as a rewrite: the rows whose key is not in gone."""
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """Distinct pairs of both: adding a link twice changes nothing."""
    return links.unionByName(new).distinct()


def mark_processed(documents: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """documents with svo_processed_at set for the ids in done."""
    flag = done.select("doc_id").distinct().withColumn("done", F.lit(True))
    joined = documents.join(flag, "doc_id", "left")
    return joined.withColumn("svo_processed_at", F.when(F.col("done"), at).otherwise(F.col("svo_processed_at"))).drop("done")


def pending_chunks(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """Chunks without a processed mark: what an incremental build still has to do."""
    return chunks.join(progress.where("processed").select("chunk_id"), "chunk_id", "left_anti")


def type_labels(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n) of entities by the label of their type."""
    return entities.join(labels, "type").groupBy("label").agg(F.count("*").alias("n"))
