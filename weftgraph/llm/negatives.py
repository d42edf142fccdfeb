"""Hard negatives by inner product: candidates in buckets by norm, pruned by the Cauchy-Schwarz bound."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.llm.common import discard, materialise, python_ready, scratch_path
from weftgraph.llm.vectors import LONG, as_python, dot, finite, integer_rows, magnitude_groups

#: Anchors that are sent to the executors at once (on average), candidates of a bucket, anchors that meet a bucket at once, and rows of a candidate partition.
ANCHOR_BLOCK, BUCKET, GROUP, PARTITION_ROWS = 16_384, 1024, 256, 250_000
#: The order of null ids among equal scores: after all others.
LAST = 2**63 - 1


@dataclass
class Wants:
    """Searches of a block of anchors: for search i the best `keep` rows for anchor[i] whose label is (or is not) the anchor's and whose score is within low[i] and high[i]."""

    vectors: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    keep: int
    norms: np.ndarray = field(init=False)

    def __post_init__(self):
        self.norms = norms(self.vectors)


def norms(rows: np.ndarray) -> np.ndarray:
    """Upper bounds of the rows' Euclidean lengths."""
    x = rows.astype(np.float64)
    return np.sqrt((x * x).sum(1)) * (1 + 1e-9)


def within_longs(values: np.ndarray) -> np.ndarray:
    """Python's integers as 64-bit ones; those out of range become the nearest that fits."""
    return values if values.dtype != object else np.array([max(-LONG, min(LONG - 1, int(v))) for v in values.ravel()], np.int64).reshape(values.shape)


class Search:
    """The best rows of some searches so far, over the buckets of one task."""

    def __init__(self, wants: Wants, some: np.ndarray):
        self.wants, self.anchors = wants, some
        self.place = np.flatnonzero(np.isin(wants.anchor, some))
        at = np.zeros(len(wants.vectors), np.int64)
        at[some] = np.arange(len(some))
        self.local = at[wants.anchor[self.place]]
        self.vectors = wants.vectors[some]
        n = len(self.place)
        self.low, self.high = wants.low[self.place], wants.high[self.place]
        self.kth, self.kth_id = np.full(n, -LONG, np.int64), np.full(n, LAST, np.int64)
        self.best = [np.zeros(0, np.int64) for _ in range(4)]  # search, score, id, row

    def offer(self, rows: np.ndarray, bound: float, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray) -> None:
        """Compare a bucket (norms at most `bound`) with the searches whose bound it can reach."""
        floor = np.maximum(self.low, self.kth).astype(np.float64)
        able = self.wants.norms[self.anchors][self.local] * bound * (1 + 1e-9) >= floor
        if not able.any():
            return
        active = np.flatnonzero(able)
        near, at = np.unique(self.local[active], return_inverse=True)
        width = max(self.vectors.shape[1], rows.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (self.vectors[near], rows))
        score = within_longs(dot(a, b))[at]
        labelled = (self.wants.labels[self.anchors[near]][:, None] == labels)[at]
        # the rows of a search that can enter: within the window, before its last one so far
        ok = (labelled == self.wants.same) & (score >= self.low[active, None]) & (score <= self.high[active, None])
        kth, last = self.kth[active, None], self.kth_id[active, None]
        ok &= (score > kth) | ((score == kth) & (ids < last))
        if self.wants.same:
            ok &= self.wants.rows[self.anchors[near]][at][:, None] != keys
        keep = self.wants.keep
        if ok.sum() > 4 * keep * len(active) and ok.shape[1] > keep:
            least = -LONG if score.dtype == np.int64 else -np.inf
            ok &= score >= np.partition(np.where(ok, score, least), -keep, axis=1)[:, -keep, None]
        r, c = np.nonzero(ok)
        if not len(r):
            return
        found = [active[r], score[r, c].astype(np.int64), ids[c], keys[c]]
        pool = [np.concatenate(x) for x in zip(self.best, found, strict=True)]
        order = np.lexsort((pool[3], pool[2], ~pool[1], pool[0]))
        search = pool[0][order]
        first = np.flatnonzero(np.append(True, search[1:] != search[:-1]))
        rank = np.arange(len(search)) - np.repeat(first, np.diff(np.append(first, len(search))))
        order, full = order[rank < keep], order[rank == keep - 1]
        self.best = [x[order] for x in pool]
        self.kth[pool[0][full]], self.kth_id[pool[0][full]] = pool[1][full], pool[2][full]


def best_rows(candidates: DataFrame, wants: Wants, scale: int) -> DataFrame:
    """(search, score, id, row, has_id) of the best rows of every search in each task; the caller merges the tasks' rows."""
    shared = candidates.sparkSession.sparkContext.broadcast(wants)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wants = shared.value
        searches = [Search(wants, g[i : i + GROUP]) for g in magnitude_groups(wants.vectors) for i in range(0, len(g), GROUP)]
        for b in batches:
            for start in range(0, b.num_rows, BUCKET):
                part = b.slice(start, BUCKET)
                ids = part.column(1).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
                keys, labels, rows = part.column(0).to_numpy(), part.column(2).cast(pa.int64()).to_numpy(), integer_rows(part.column(3), scale)
                for g in magnitude_groups(rows):
                    bound = float(norms(rows[g]).max())
                    for s in searches:
                        s.offer(rows[g], bound, ids[g], keys[g], labels[g])
        for s in searches:
            search, score, ids, keys = s.best
            yield pa.RecordBatch.from_arrays([pa.array(s.place[search], pa.int64()), pa.array(score), pa.array(ids), pa.array(keys)], names=["search", "score", "id", "row"])

    out = candidates.select("row", "id", "label", "v").mapInArrow(run, "search long, score long, id long, row long")
    out._weftgraph_shared = shared
    return out


def ranked(rows: DataFrame, keep: int) -> DataFrame:
    """The best `keep` rows of each search over all tasks, with their rank from 1."""
    order = W.partitionBy("search").orderBy(F.desc("score"), "id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def by_norm(df: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """The rows that take part (row, id, label, v, norm), written in descending order of norm over equal partitions; equal norms are spread by id."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.floor(x * scale).cast("double") * F.floor(x * scale).cast("double")))
    given = df.where(F.col(f"`{label_col}`").isNotNull() & finite(F.col(f"`{vec_col}`"))).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), v.alias("v"), norm.alias("norm"))
    order = (F.desc("norm"), F.asc_nulls_last("id"), F.asc("label"))
    parts = max(2 * df.sparkSession.sparkContext.defaultParallelism, df.count() // PARTITION_ROWS + 1)
    dealt = given.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialise(dealt.withColumn("row", F.monotonically_increasing_id()), "norm-buckets")


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    Vectors are integers floor(scale * x), scores their exact inner products.
    An anchor's positives are the best `positives` other rows of its label;
    for each, the best `negatives` rows of other labels with
    low * positive_score <= score <= high * positive_score (fractions) are
    returned. Higher scores come first, then smaller ids, null ids last.

    Rows are written once in descending order of norm. Anchors go out in
    blocks of bounded size (`is_anchor` is a condition on `id`), each a
    broadcast that meets every bucket of rows but those whose greatest norm
    times the anchor's cannot reach the window's lower limit or the last score
    kept so far. Tasks hand on at most `positives` or `negatives` rows a
    search, so no group is ever gathered and no pair is listed; lost executors
    cost the partitions they had in one pass.

    Rows with a null label, a null vector or a null, NaN or infinite component
    take no part. Vectors of unequal length are compared as if the shorter
    ended in zeros. Repeated rows are rows of their own (a copy of an anchor
    is another row, and is an anchor too); a table without anchors gives no
    rows. Scores out of a long's range count as the nearest long.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = df.sparkSession
    python_ready(spark)
    candidates = by_norm(df, id_col, label_col, vec_col, scale)
    anchors = candidates.where(F.coalesce(is_anchor, F.lit(False)))
    blocks = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    out = scratch_path(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    given_back = F.when(F.col("id") != LAST, F.col("id"))
    for block in range(blocks):
        rows = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("row", "id", "label", "v").toArrow()
        keys, ids, labels, vectors = (c.combine_chunks() for c in rows.columns)
        n = len(keys)
        matrix, labels, keys = integer_rows(vectors, scale), labels.to_numpy(zero_copy_only=False), keys.to_numpy(zero_copy_only=False)
        every = np.arange(n)
        first = best_rows(candidates, Wants(matrix, labels, keys, every, np.full(n, -LONG, np.int64), np.full(n, LONG - 1, np.int64), True, positives), scale)
        found = ranked(first, positives).select("search", given_back.alias("id"), "score").orderBy("search", "rank").toArrow()
        anchor, score = found["search"].to_numpy(), found["score"].to_numpy()
        p = as_python(score)
        least, most = (np.array([-(-low[0] * x // low[1]) for x in p], object), np.array([high[0] * x // high[1] for x in p], object))
        # a positive without a window has no negatives
        open_ = np.flatnonzero(np.array([a <= b for a, b in zip(least, most, strict=True)], bool))
        second = best_rows(candidates, Wants(matrix, labels, keys, anchor[open_], within_longs(least[open_]), within_longs(most[open_]), False, negatives), scale)
        named = pa.table({"search": pa.array(np.arange(len(open_)), pa.int64()), "anchor_id": ids.take(pa.array(anchor[open_], pa.int64())), "positive_id": found["id"].combine_chunks().take(pa.array(open_, pa.int64())), "positive_score": pa.array(score[open_], pa.int64())})
        best = ranked(second, negatives).select("search", "rank", given_back.alias("negative_id"), F.col("score").alias("negative_score"))
        # one row per search of this block: the block bounds it
        best.join(F.broadcast(spark.createDataFrame(named)), "search").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
        for done in (first, second):
            done._weftgraph_shared.destroy()
    discard(candidates)
    return spark.read.schema(schema).parquet(out)


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


OP13_SQL = """WITH given AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM given a JOIN given r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
  positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
  SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM positives JOIN pairs USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""
