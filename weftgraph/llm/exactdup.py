"""Exact deduplication on a 128-bit content hash, verified byte by byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import BLANK, few, materialise, row_hash, temporary, without_rows
from weftgraph.operators.joins import spread_join


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def _members(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with keep_id, keep_row and group_size of their group; no task gets all rows of a large group."""
    order = F.struct(F.negative("len").alias("len"), F.col("id").isNull().alias("none"), "id", "row", "place")
    best = rows.groupBy(*key).agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    best = best.select(*key, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("best.place").alias("keep_place"), "group_size", F.col("group_size").alias("n"))
    return spread_join(rows, materialise(best, "exact-best"), key, "n")


def exact_members(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=normalised) -> DataFrame:
    """One row per row of df: id, row (its hash), place (its number), sha and keep_id, keep_row, keep_place, group_size of its group.

    The first pass reads every text once and writes hashes, lengths and ids.
    Texts are then moved for MD5 values that several different rows have, and
    nothing else: the least and the greatest text of each such group by byte
    order, combined on the map side, are equal exactly if all its texts are.
    A group whose extremes differ is a hash collision; its rows are grouped by
    the text itself.
    """
    norm = normalise(F.col(f"`{text_col}`"))
    raw = df.select(F.col(f"`{id_col}`").alias("id"), row_hash(df).alias("row"), F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("len"), norm.alias("norm"))
    raw = raw.withColumn("h", F.unhex(F.md5("norm")))
    rows = materialise(raw.select("id", "row", "len", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), F.monotonically_increasing_id().alias("place")), "exact-rows")
    shared = materialise(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "exact-shared")
    groups = raw.select("h", "norm").join(few(shared), "h", "left_semi").groupBy("h").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi"))
    clashes = materialise(groups.where("lo <> hi").select("h"), "exact-clashes")
    if clashes.isEmpty():
        return _members(rows, ["h"])
    texts = raw.join(few(clashes), "h", "left_semi").select("row", "norm").dropDuplicates(["row"])
    apart = rows.join(few(clashes), "h", "left_semi").join(texts, "row")
    return _members(rows.join(few(clashes), "h", "left_anti"), ["h"]).unionByName(_members(apart, ["norm"]).drop("norm"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=normalised) -> DataFrame:
    """One row per row of df: the group of equal normalised texts it belongs to, by `exact_members`.

    The row with the most code points in the original text, then the smallest
    id (of any type that can be ordered), then the smallest row hash stays.
    Null text counts as empty, null ids lose every tie (if a group has only
    null ids, keep_id is null). Rows that are equal in every column are each
    reported, and one of them, whichever, is kept. Very long texts are hashed and compared
    whole. An empty table gives no rows. Other columns only tell rows apart;
    their names may be any.
    Returns id, keep_id, group_size, kept, text_sha256.
    """
    members = exact_members(df, id_col, text_col, normalise)
    kept = F.col("place") == F.col("keep_place")
    return members.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the exact copies that `exact_groups` does not keep; columns unchanged.

    Rows are told apart by all their columns: two texts under one id are two
    rows, and rows that are equal in every column leave one.
    """
    with temporary(df.sparkSession) as kept:
        others = materialise(exact_members(df, id_col, text_col).where("place <> keep_place").select("row", "keep_row"), "exact-others")
        gone = materialise(others.where("row <> keep_row").select("row").distinct(), "exact-gone")
        once = materialise(others.where("row = keep_row").select("row").distinct(), "exact-once")
        kept.extend((gone, once))
    return without_rows(df, gone, once)


def op6_exact(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY sha ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY sha ORDER BY len DESC, doc_id) AS kept,
       sha AS text_sha256
FROM n
"""
