"""Change log, difference and snapshot of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def change_type() -> Column:
    return F.when(F.col("updated_at").isNull(), "created").otherwise("updated")


def changelog(edges: DataFrame, key: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of edges by their last change, newest first."""
    at = F.coalesce("updated_at", "created_at")
    return edges.withColumns({"changed_at": at, "change_type": change_type()}).orderBy(F.desc("changed_at"), *key).offset(offset).limit(limit)


def diff(edges: DataFrame, since: Column, key: list[str], limit: int = 200) -> DataFrame:
    """Edges created or updated from `since` on, newest first."""
    hit = F.coalesce((F.col("created_at") >= since) | (F.col("updated_at") >= since), F.col("created_at") >= since, F.lit(False))
    return changelog(edges.where(hit), key, 0, limit)


def diff_counts(changes: DataFrame) -> DataFrame:
    """Created and updated rows of a (limited) difference."""
    return changes.agg(F.count_if(F.col("change_type") == "created").alias("created_count"), F.count_if(F.col("change_type") == "updated").alias("updated_count"))


def snapshot(edges: DataFrame, at: Column, key: list[str], limit: int = 500) -> DataFrame:
    """Edges created by `at`, oldest first, as they are now."""
    return edges.where(F.col("created_at") <= at).orderBy("created_at", *key).limit(limit)


def valid_time(text: Column) -> Column:
    """Whether a text is a time: what else would be refused."""
    return F.try_to_timestamp(text).isNotNull()
