"""Terms, skills, shards and entity alignment across instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C


def synonym_table(spark: SparkSession) -> DataFrame:
    """(term, group_id): 103 terms; a term of two groups belongs to the later one."""
    last = {t: i for i, group in enumerate(C.SYNONYMS) for t in group}
    return spark.createDataFrame([(t, i) for t, i in last.items()], "term string, group_id int")


def expand_terms(terms: DataFrame, synonyms: DataFrame, per: int = 3) -> DataFrame:
    """(pos, term): each term (pos, term) once by case, followed by at most `per` unseen members of its group in order."""
    groups = terms.withColumn("low", F.lower("term")).join(F.broadcast(synonyms.select(F.col("term").alias("low"), "group_id")), "low", "left")
    members = groups.join(F.broadcast(synonyms.withColumnRenamed("term", "member")), "group_id").where("member <> low")
    mine = members.withColumn("k", F.row_number().over(W.partitionBy("pos").orderBy("member"))).where(F.col("k") <= per)
    rows = groups.select("pos", F.lit(0).alias("k"), "term").unionByName(mine.select("pos", "k", F.col("member").alias("term")))
    first = rows.groupBy(F.lower("term").alias("low")).agg(F.min(F.struct("pos", "k", "term")).alias("r"))  # a frequent term meets itself on the map side
    return first.select("r.*")


def synonyms_of(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(term, group): the sorted members of each term's group, empty when unknown."""
    packed = synonyms.groupBy("group_id").agg(F.array_sort(F.collect_list("term")).alias("members"))
    found = terms.withColumn("low", F.lower("term")).join(F.broadcast(synonyms.withColumnRenamed("term", "low")), "low", "left").join(F.broadcast(packed), "group_id", "left")
    return found.select("term", F.coalesce(F.array_join("members", "|"), F.lit("")).alias("members"))


def skill_score(terms: DataFrame, concepts: DataFrame) -> DataFrame:
    """(owner_id, score): share of the terms that contain or are contained in a concept of the owner, case folded; terms are one question's."""
    low = concepts.select("owner_id", F.lower("name").alias("name")).distinct()
    t = F.broadcast(terms.select(F.lower("term").alias("term")).distinct())
    total = terms.select(F.lower("term").alias("term")).distinct().agg(F.count("*").alias("n"))
    hits = low.join(t, F.col("name").contains(F.col("term")) | F.col("term").contains(F.col("name"))).select("owner_id", "term").distinct().groupBy("owner_id").agg(F.count("*").alias("hits"))
    return hits.join(F.broadcast(total), F.lit(True)).select("owner_id", F.round(F.col("hits") / F.col("n"), 4).alias("score"))


def first_seen(rows: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row of each key in the order of `seq`."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(*key).orderBy(seq))).where("rn = 1").drop("rn")


def merge_registry(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local skills and the remote ones whose kb_id is not local."""
    return local.unionByName(remote.join(local.select("kb_id"), "kb_id", "left_anti"))


def sync_registry(registry: DataFrame, public: DataFrame) -> DataFrame:
    """Registry after a sync: remote rows stay, local rows are exactly the public ones."""
    remote = registry.where("not is_local").join(public.select("kb_id"), "kb_id", "left_anti")
    return remote.unionByName(public)


def align(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Entities (seq, name, instance_id, degree) of one meaning: key, canonical name (first seen), max degree, number and sorted list of instances.

    The key is the least member of the synonym group, else the lower-case name.
    """
    least = synonyms.groupBy("group_id").agg(F.min("term").alias("key"))
    table = synonyms.join(least, "group_id").select(F.col("term").alias("low"), F.col("key").alias("group_key"))
    keyed = entities.withColumn("low", F.lower("name")).join(F.broadcast(table), "low", "left").withColumn("key", F.coalesce("group_key", "low"))
    return keyed.groupBy("key").agg(F.min_by("name", "seq").alias("canonical_name"), F.max("degree").alias("max_degree"), F.array_sort(F.collect_set("instance_id")).alias("instances"), F.count("*").alias("members")).withColumn("instance_count", F.size("instances").cast("long"))


def best_degree(entities: DataFrame) -> DataFrame:
    """Entities of one name over graphs: the graph with the highest degree."""
    order = F.struct("degree", F.negative("kg_id"))
    return entities.groupBy(F.lower("name").alias("name")).agg(F.max_by("kg_id", order).alias("kg_id"), F.max("degree").alias("degree"))


def quota(rows: DataFrame, limit: int, order: list[Column], times: int = 1) -> DataFrame:
    """At most max(1, limit // graphs) * times rows per graph."""
    graphs = rows.agg(F.countDistinct("kg_id").alias("n"))
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("kg_id").orderBy(*order)))
    most = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n"))) * times
    return ranked.join(F.broadcast(graphs), F.lit(True)).where(F.col("rn") <= most).drop("n")


def shard_union(facts: DataFrame) -> DataFrame:
    """Facts (shard, seq, status, fact) of all shards that answered, first seen over (shard, seq)."""
    ok = facts.where("status = 'ok'").withColumn("at", F.struct("shard", "seq"))
    return first_seen(ok, ["fact"], "at").drop("at")
