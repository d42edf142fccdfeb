"""Clusters of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.operators.scoring import mean_pair_cosine
from weftgraph.operators.selfjoin import similar_groups
from weftgraph.session import materialise


def threshold_components(centroids: DataFrame, owner: str, least: float = C.CLUSTER_COS) -> DataFrame:
    """(node, component) of all owners: components of the pairs with a cosine from `least` on; others stand alone."""
    return similar_groups(centroids, owner, "centroid", least)


def unmatched(links: DataFrame, scores: DataFrame, least: float = C.ROUTE_MIN, owner: str = "owner_id") -> DataFrame:
    """The links of owners that wait for a graph: those without a score (owner, score), and those whose best is under `least`."""
    placed = scores.where(F.col("score") >= least).select(owner).distinct()
    return links.join(placed, owner, "left_anti")


def cluster_documents(centroids: DataFrame, owner: str, concepts: DataFrame, least: float = C.CLUSTER_COS, smallest: int = C.CLUSTER_MIN) -> DataFrame:
    """(component, size, similarity, top_concepts): components whose mean over all member pairs reaches `least`."""
    labels = materialise(threshold_components(centroids, owner, least), "cluster-labels")
    sizes = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= smallest)
    members = centroids.join(labels.withColumnRenamed("node", owner), owner)
    mean = mean_pair_cosine(members, "component", "centroid").select("component", F.round("similarity", 3).alias("similarity"))
    kept = sizes.join(mean, "component").where(F.col("similarity") >= least)
    names = concepts.join(labels.withColumnRenamed("node", owner), owner).groupBy("component", "name").agg(F.count("*").alias("n"))
    top = names.withColumn("rn", F.row_number().over(W.partitionBy("component").orderBy(F.desc("n"), "name"))).where(F.col("rn") <= 15)
    top = top.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("rn", "name"))).alias("t")).select("component", F.array_join(F.transform("t", lambda x: x["name"]), "|").alias("top_concepts"))
    return kept.join(top, "component", "left")
