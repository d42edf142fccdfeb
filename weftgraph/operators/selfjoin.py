"""Similarity self-join of vectors: all pairs from a cosine on, by blocks that the triangle inequality can't part."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from weftgraph.functions.vectors import norm
from weftgraph.operators.components import connected_components
from weftgraph.operators.joins import spread_join
from weftgraph.session import materialise, ship_package

#: Rows of a block, rows of one matrix product's strip, centres (which are the pivots too), rings of a cell by the angle to its centre, and rows that centres are fitted on.
BLOCK, STRIP, CENTRES, RINGS, FIT_ROWS = 4096, 512, 256, 64, 20_000
#: Blocks that a task takes from each side at most, and groups that there are at least before blocks go together.
TOGETHER, LEAST_GROUPS = 8, 8
#: Pairs of blocks are ruled out only beyond this much of angle, and cosines are taken again in full from this much below the limit: both far above rounding errors.
ANGLE_SLACK, COS_SLACK = 1e-6, 1e-6
#: Half of the last place of a similarity, which is rounded to 6 places.
HALF = 5e-7


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return np.asarray(values.flatten(), dtype=np.float64).reshape(-1, width)


def cosines_from(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine) of the rows of two blocks whose cosine rounds to `least` or more; in one block each pair once, i < j.

    A matrix product finds the candidates; their cosines are then summed from
    the first component to the last, as the SQL expression does.
    """
    ua, ub, found = a / na[:, None], (b / nb[:, None]).T, []
    for at in range(0, len(a), STRIP):
        x, y = np.nonzero(ua[at : at + STRIP] @ ub >= least - COS_SLACK)
        keep = y > x + at if same else slice(None)
        found.append((x[keep] + at, y[keep]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    total = np.zeros(len(i))
    for d in range(a.shape[1]):
        total += a[i, d] * b[j, d]
    cos = np.clip(total / (na[i] * nb[j]), -1.0, 1.0)
    keep = cos >= least - HALF
    return i[keep], j[keep], cos[keep]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect what the edges (i, j) over n nodes connect: fewer than n of them."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        after = after[after]
        if np.array_equal(after, label):
            node = np.nonzero(label != np.arange(n))[0]
            return node, label[node]
        label = after


class SelfJoin:
    """All pairs of rows (key, vector) whose cosine, rounded to 6 places, is at least `least`.

    Every vector stands in the cell of its nearest centre, and in a block of
    at most about BLOCK rows among those of its cell at like angles to it (equal
    vectors without end fall into many blocks of one ring). A block knows the
    least and greatest angle of its rows to every centre. Angles obey the
    triangle inequality, so two blocks whose angles to any one centre lie
    further apart than acos(least) hold no pair: they are ruled out, cells
    first, then blocks. What remains is multiplied block by block. No pair is
    lost, whatever the centres are; bad centres only rule out less. Vectors of
    one length or none at all alike (random directions and a low limit) leave
    all pairs of blocks, which is then what has to be read.

    Keys must be unique. Null keys, null vectors and vectors without length
    (under 1e-9, which have cosine 0 with all) are in no pair, so `least` must
    be above 0; all vectors have one length, without null or non-finite
    components.
    """

    def __init__(self, rows: DataFrame, key: str, vector: str, least: float, block: int = BLOCK, centres: int | None = None, seed: int = 42):
        if not 0 < least <= 1:
            raise ValueError("least must be above 0, at most 1")
        self.spark, self.least, self.block, self.seed, self.wanted = rows.sparkSession, least, block, seed, centres
        ship_package(self.spark)
        v = F.col(vector).cast("array<double>")
        # the norm is rounded nowhere: pairs are compared with the expression's own cosine
        self.rows = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), v.alias("v"), norm(v).alias("norm")).where("norm >= 1e-9")

    @cached_property
    def centres(self) -> np.ndarray:
        """Unit centres, at most CENTRES of them, fitted on about FIT_ROWS rows chosen by a hash of the vector."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = self.count
        fit = self.rows.select(F.transform("v", lambda x: x / F.col("norm")).alias("u"))
        if n > FIT_ROWS:  # by key and vector, so that copies of one vector come in their share
            fit = self.rows.where(F.pmod(F.xxhash64("key", "v", F.lit(self.seed)), F.lit(1 << 30)) < int(FIT_ROWS / n * (1 << 30))).select(F.transform("v", lambda x: x / F.col("norm")).alias("u"))
        k = self.wanted or min(CENTRES, n // self.block)
        if k < 2 or n <= self.block:
            first = self.rows.orderBy("key").limit(1).select("v", "norm").first()
            return np.asarray([first["v"]]) / first["norm"]
        model = KMeans(k=k, seed=self.seed, featuresCol="f", maxIter=10).fit(fit.select(array_to_vector("u").alias("f")))
        got = np.asarray(model.clusterCenters(), dtype=np.float64)
        size = np.linalg.norm(got, axis=1, keepdims=True)
        return got[size[:, 0] > 1e-9] / size[size[:, 0] > 1e-9]

    @cached_property
    def count(self) -> int:
        return self.rows.count()

    @cached_property
    def blocks(self) -> DataFrame:
        """(block, cell, n, lo, hi, keys, v, norms): packed rows; lo and hi are the angles to every centre."""
        width = self.rows.select(F.size("v").alias("n")).first()["n"]
        kind = self.rows.schema["key"].dataType
        centres, block = self.centres, self.block

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _matrix(b.column(1), width)
                angle = np.arccos(np.clip(v / np.asarray(b.column(2))[:, None] @ centres.T, -1.0, 1.0))
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int64()), pa.array(angle.min(axis=1))], names=["key", "v", "norm", "cell", "angle"])

        schema = T.StructType([*self.rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("angle", T.DoubleType())])
        placed = materialise(self.rows.mapInArrow(place, schema), "selfjoin-rows")
        # a cell of one block has one ring
        rings = placed.groupBy("cell").agg(F.least(F.ceil(F.count("*") / block), F.lit(RINGS)).alias("rings"), F.min("angle").alias("from"), F.max("angle").alias("to"))
        wide = F.col("to") - F.col("from")
        ring = F.when(wide > 0, F.least(F.floor((F.col("angle") - F.col("from")) / wide * F.col("rings")), F.col("rings") - 1)).otherwise(F.lit(0)).cast("long")
        placed = placed.join(F.broadcast(rings), "cell").withColumn("ring", ring).select("key", "v", "norm", "cell", "ring")
        sizes = placed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / block).alias("parts"))  # CENTRES * RINGS rows at most
        numbered = placed.join(F.broadcast(sizes), ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("key", F.lit(self.seed)), F.col("parts")))

        def pack(t: pa.Table) -> pa.Table:
            t = t.combine_chunks()
            v = _matrix(t.column("v").combine_chunks(), width)
            angle = np.arccos(np.clip(v / np.asarray(t.column("norm"))[:, None] @ centres.T, -1.0, 1.0))
            first = [t.column(c)[0].as_py() for c in ("cell", "ring", "part")]
            cell, lo, hi = pa.array([first[0]], pa.int64()), pa.array([angle.min(axis=0).tolist()]), pa.array([angle.max(axis=0).tolist()])
            name = pa.array(["{:04d}-{:02d}-{:08d}".format(*first)])
            keys = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t.column("key").combine_chunks())
            return pa.Table.from_arrays([name, cell, pa.array([len(t)], pa.int64()), lo, hi, keys, pa.array([v.tobytes()], pa.binary()), pa.array([np.asarray(t.column("norm")).tobytes()], pa.binary())], names=["block", "cell", "n", "lo", "hi", "keys", "v", "norms"])

        out = T.StructType([T.StructField("block", T.StringType()), T.StructField("cell", T.LongType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("lo", "hi")], T.StructField("keys", T.ArrayType(kind)), T.StructField("v", T.BinaryType()), T.StructField("norms", T.BinaryType())])
        return materialise(numbered.groupBy("cell", "ring", "part").applyInArrow(pack, out), "selfjoin-blocks")

    @cached_property
    def plan(self) -> DataFrame:
        """(a, b, rows): the pairs of blocks, a <= b, that may hold a pair of rows, with the pairs of rows to look at."""
        reach = float(np.arccos(max(-1.0, self.least - COS_SLACK))) + ANGLE_SLACK
        ends = self.blocks.select("block", "cell", "n", "lo", "hi")
        at = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("lo") - 1).alias("pivot"), "lo", "hi")).alias("e")
        spans = ends.select("cell", at).groupBy("cell", "e.pivot").agg(F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi")).collect()  # CENTRES squared at most
        cells = sorted({r["cell"] for r in spans})
        number = {c: i for i, c in enumerate(cells)}
        lo, hi = (np.zeros((len(cells), len(self.centres))) for _ in range(2))
        for r in spans:
            lo[number[r["cell"]], r["pivot"]], hi[number[r["cell"]], r["pivot"]] = r["lo"], r["hi"]
        near = [(c, d) for i, c in enumerate(cells) for j, d in enumerate(cells) if max((lo[i] - hi[j]).max(), (lo[j] - hi[i]).max()) <= reach]
        links = F.broadcast(self.spark.createDataFrame(near, "cell_a long, cell_b long"))
        a, b = ends.select(*[F.col(c).alias(f"{c}_a") for c in ends.columns]), ends.select(*[F.col(c).alias(f"{c}_b") for c in ends.columns])
        met = a.join(links, "cell_a").join(b, "cell_b").where("block_a <= block_b")
        apart = lambda low, high: F.exists(F.zip_with(low, high, lambda x, y: x - y), lambda x: x > reach)
        met = met.where(~apart(F.col("lo_a"), F.col("hi_b")) & ~apart(F.col("lo_b"), F.col("hi_a")))
        seen = F.when(F.col("block_a") == F.col("block_b"), F.expr("n_a * (n_a - 1) div 2")).otherwise(F.col("n_a") * F.col("n_b"))
        return materialise(met.select(F.col("block_a").alias("a"), F.col("block_b").alias("b"), seen.alias("rows")), "selfjoin-plan")

    def examined(self) -> int:
        """Pairs of rows that the join looks at."""
        return self.plan.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()["n"] if self.count else 0

    def sent(self) -> DataFrame:
        """(group_a, group_b, block, mates): the blocks of each task, and the blocks that each is compared with there."""
        # neighbours by name stand in one group; their names alone pass one task
        blocks = self.blocks.select("block")
        together = max(1, min(TOGETHER, blocks.count() // LEAST_GROUPS))
        group = F.floor((F.row_number().over(W.orderBy("block")) - 1) / together)
        group = blocks.select("block", group.alias("group"))
        met = self.plan.select("a", "b")
        for side in ("a", "b"):
            met = met.join(F.broadcast(group.select(F.col("block").alias(side), F.col("group").alias(f"group_{side}"))), side)
        met = met.select("group_a", "group_b", F.explode(F.array(F.struct(F.col("a").alias("block"), F.col("b").alias("mate")), F.struct(F.col("b").alias("block"), F.lit(None).cast("string").alias("mate")))).alias("e"))
        return met.select("group_a", "group_b", "e.*").groupBy("group_a", "group_b", "block").agg(F.collect_set("mate").alias("mates"))

    def _compared(self, emit: Callable, fields: str) -> DataFrame:
        """emit's table of every pair of blocks in the plan; a task holds two groups of TOGETHER blocks, so a block is sent once per group, not per block, that it meets."""
        kind = self.rows.schema["key"].dataType.simpleString()
        schema = fields.replace("KEY", kind)
        if not self.count:
            return self.spark.createDataFrame([], schema)
        least = self.least
        sides = self.sent()
        given = sides.join(self.blocks.select("block", "keys", "v", "norms"), "block").select("group_a", "group_b", "block", "mates", "keys", "v", "norms")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sides, mates = {}, {}
            for t in batches:
                for at, block in enumerate(t.column("block").to_pylist()):
                    norms = np.frombuffer(t.column("norms")[at].as_py())
                    sides[block] = t.column("keys")[at].values, np.frombuffer(t.column("v")[at].as_py()).reshape(len(norms), -1), norms
                    mates[block] = sorted(t.column("mates")[at].as_py())
            for a in sorted(mates):
                for b in mates[a]:
                    (ka, va, na), (kb, vb, nb) = sides[a], sides[b]
                    yield from emit(ka, kb, *cosines_from(va, na, vb, nb, least, a == b), a == b).to_batches(max_chunksize=100_000)

        return given.groupBy("group_a", "group_b").applyInArrow(compare, schema)

    def pairs(self) -> DataFrame:
        """(a, b, sim) of all pairs, a < b, sim rounded to 6 places."""

        def emit(ka, kb, i, j, cos, same):
            return pa.table({"a": ka.take(pa.array(i)), "b": kb.take(pa.array(j)), "sim": pa.array(cos)})

        got = self._compared(emit, "a KEY, b KEY, sim double")
        return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("sim", 6).alias("sim")).where(F.col("sim") >= self.least)

    def links(self) -> DataFrame:
        """(a, b): pairs that connect the same rows as all pairs do, fewer than two blocks' rows per pair of blocks."""

        def emit(ka, kb, i, j, cos, same):
            keys = ka if same else pa.concat_arrays([ka, kb])
            node, root = forest(i, j if same else j + len(ka), len(keys))
            return pa.table({"a": keys.take(pa.array(node)), "b": keys.take(pa.array(root))})

        return self._compared(emit, "a KEY, b KEY")


def similar_pairs(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(a, b, sim) of all pairs a < b of rows whose cosine is at least `least`."""
    return SelfJoin(rows, key, vector, least).pairs()


def similar_groups(rows: DataFrame, key: str, vector: str, least: float) -> DataFrame:
    """(node, component) of every row with a key: components of the pairs with a cosine of at least `least`; others stand alone.

    Rows of one vector are one row of the join, the one of the smallest key,
    so copies aren't compared with one another.
    """
    v = F.col(vector).cast("array<double>")
    given = materialise(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("node"), v.alias("v")), "groups-rows")
    distinct = materialise(given.where("v is not null").groupBy("v").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "groups-distinct")
    labels = connected_components(SelfJoin(distinct, "rep", "v", least).links(), "a", "b").select(F.col("node").alias("rep"), "component")
    long = distinct.where(norm(F.col("v")) >= 1e-9).join(labels, "rep", "left").select("v", F.coalesce("component", "rep").alias("component"), "n")
    found = spread_join(given, materialise(long, "groups-labels"), ["v"], "n", given.count())
    alone = given.where(F.col("v").isNull() | (norm(F.col("v")) < 1e-9)).select("node", F.col("node").alias("component"))
    return found.select("node", "component").unionByName(alone)
