"""Centroid clustering in exact integers: blocked products, sums by treeAggregate."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import python_ready
from weftgraph.llm.vectors import as_python, finite, integer_rows, longs, magnitude_groups, squared_distances

#: Rows whose distances to all centroids are held at once.
BLOCK = 4096


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each row, exact; ties go to the smaller number.

    Rows and centroids of ordinary magnitude meet in float64 BLAS, whose
    partial sums stay below 2^53; larger ones in 64-bit or Python's integers.
    """
    groups = magnitude_groups(centroids)
    if len(groups) == 1 and len(magnitude_groups(rows)) < 2:
        d = squared_distances(rows, centroids)
        at = d.argmin(1)
        low = d[np.arange(len(d)), at]
        return at, low if low.dtype == object else low.astype(np.int64)
    at, low = np.zeros(len(rows), np.int64), np.empty(len(rows), object)
    for some in magnitude_groups(rows):
        options = []
        for g in groups:
            d = squared_distances(rows[some], centroids[g])
            first = d.argmin(1)
            options.append(zip(as_python(d[np.arange(len(d)), first]), g[first].tolist(), strict=True))
        for i, best in zip(some.tolist(), map(min, zip(*options, strict=True)), strict=True):
            low[i], at[i] = best
    return at, low


class Sums:
    """Count, componentwise sum and distance sum per cluster, in Python's integers."""

    def __init__(self, k: int, width: int):
        self.counts, self.inertia = np.zeros(k, object), np.zeros(k, object)
        self.sums = np.zeros((k, width), object)

    def add(self, rows: np.ndarray, at: np.ndarray, low: np.ndarray) -> Sums:
        for c in np.unique(at).tolist():
            mine = rows[at == c]
            self.counts[c] += len(mine)
            # a block's sum of ordinary values stays below 2^53; larger ones are added one by one
            for g in magnitude_groups(mine):
                part = mine[g]
                exact = part.dtype != object and len(part) * np.abs(part).max(initial=0) < 2.0**53
                self.sums[c] += as_python((part if exact else as_python(part)).sum(0))
            self.inertia[c] += int(as_python(low[at == c]).sum())
        return self

    def merge(self, other: Sums) -> Sums:
        self.counts, self.sums, self.inertia = self.counts + other.counts, self.sums + other.sums, self.inertia + other.inertia
        return self


@dataclass
class Clustering:
    """Centroids as integer rows, with the rows' count and distance sum of each when assigned to the nearest."""

    centroids: np.ndarray
    counts: list[int]
    inertia: list[int]
    scale: int

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, as_python(c))).encode()).hexdigest() for c in self.centroids]


def kept(df: DataFrame, vec: str, width: int) -> Column:
    """Whether a row's vector has `width` components, none null or non-finite."""
    v = F.col(f"`{vec}`")
    return F.coalesce((F.size(v) == width) & finite(v), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch], at: int, scale: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for start in range(0, b.num_rows, BLOCK):
            part = b.slice(start, BLOCK)
            yield part, integer_rows(part.column(at), scale, width)


def _totals(vectors: DataFrame, centroids: np.ndarray, scale: int) -> Sums:
    """Sums of all vectors by their nearest centroid: one row per partition, combined in a tree on the executors."""
    k, width = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums(k, width)
        for _, rows in _blocks(batches, 0, scale, width):
            total.add(rows, *nearest(rows, centroids))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    parts = vectors.mapInArrow(partial, "part binary").rdd.map(lambda r: pickle.loads(r["part"]))
    return parts.treeAggregate(Sums(k, width), Sums.merge, Sums.merge)


def fit(df: DataFrame, k: int, rounds: int, width: int, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering | None:
    """k centroids of df's vectors as integers floor(scale * x), after `rounds` of assignment and replacement.

    The start are the k vectors whose ids have the smallest SHA-256 of seed and
    id (null ids last, equal ids by their components). Each round every
    non-empty centroid becomes the floor of its vectors' exact mean; empty ones
    stay. Only k vectors and their sums ever reach the driver; a round is one
    pass that reads the vector column alone, and a lost executor costs its
    partitions of one pass.

    Vectors that are null, of another width, or with a null or non-finite
    component take no part; fewer than k vectors are as many centroids, and
    none at all give None. Repeated rows count as often as they occur.
    """
    python_ready(df.sparkSession)
    given = df.where(kept(df, vec_col, width)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    first = given.orderBy(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return None
    centroids = integer_rows(pa.array([r["v"] for r in first], pa.list_(pa.float64())), scale, width)
    for _ in range(rounds):
        total = _totals(given.select("v"), centroids, scale)
        moved = [[s // n for s in sums] if n else list(as_python(old)) for old, sums, n in zip(centroids, total.sums, total.counts, strict=True)]
        centroids = np.array(moved, object)
        if not any(abs(x) >= 2**53 for c in moved for x in c):
            centroids = centroids.astype(np.float64)
    total = _totals(given.select("v"), centroids, scale)
    return Clustering(centroids, list(total.counts), list(total.inertia), scale)


def assign(df: DataFrame, found: Clustering, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that `fit` keeps.

    Sums and distances out of a long's range are null. Ids are passed on as
    they are, null ones too.
    """
    python_ready(df.sparkSession)
    k, width = found.centroids.shape
    digests, each, total = pa.array(found.digests()), longs(np.array(found.inertia, object)), longs([sum(found.inertia)])[0]
    given = df.where(kept(df, vec_col, width)).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    names = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    centroids, scale = found.centroids, found.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _blocks(batches, 1, scale, width):
            at, low = nearest(rows, centroids)
            c = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), c, longs(low), each.take(c), pa.repeat(total, len(c)), digests.take(c)], names=names)

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").withColumnRenamed("id", id_col)


def op11_centroids(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = fit(vectors, k=40, rounds=5, width=64)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return assign(vectors, found)


def _sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """The same in SQL, one pair of steps per round."""

    def assigned(r: int) -> str:
        d = "list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v)"
        return f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.v, min({{'d': {d}, 'c': c.c}}) AS m FROM points p CROSS JOIN c{r} c GROUP BY p.vec_id, p.v)"

    steps = [
        f"points AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM points ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        steps += [
            assigned(r),
            f"s{r} AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS v FROM (SELECT m.c AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{r} CROSS JOIN range(1, {width + 1}) t(i) GROUP BY m.c, i) GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(s.v, c.v) AS v FROM c{r} c LEFT JOIN s{r} s ON s.c = c.c)",
        ]
    steps.append(assigned(rounds))
    sha = "sha256(list_aggregate(list_transform(c.v, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','))"
    return f"""WITH {", ".join(steps)} SELECT a.vec_id, a.m.c::INTEGER AS cluster, a.m.d::BIGINT AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
      (sum(a.m.d) OVER ())::BIGINT AS inertia, {sha} AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"""


OP11_SQL = _sql()
