"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from weftgraph.llm.common import few, materialise, row_hash, python_ready, word_count

#: Sources that one plan may have: it is computed on the driver and broadcast. More are refused, not cut.
MOST_SOURCES = 200_000
#: Rows of a source per hash bucket: what one task sorts to place the last fractional repetition.
BUCKET_ROWS = 8192
#: Exchanges of one taken document for another that narrow the last gap of a source.
EXCHANGES = 16


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, max_epochs: float) -> list[float]:
    """Share `total` by weight, no source above max_epochs times its size.

    Sources above their cap are clamped and the excess is shared again among
    the others in proportion to their weights, until none is above. If every
    source is capped, the sum stays below `total`.
    """
    target = [0.0] * len(sizes)
    free = [i for i, w in enumerate(weights) if w > 0 and sizes[i] > 0]
    left = float(total)
    while free:
        level = left / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * level > max_epochs * sizes[i]]
        if not over:
            for i in free:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = float(max_epochs * sizes[i])
            left -= target[i]
        capped = set(over)
        free = [i for i in free if i not in capped]
    return target


def cyclic_weights(sources: Sequence[str | None]) -> list[float]:
    """1, 2, 3, repeating, over the sources by code point with null last."""
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, sources[i] or ""))
    weights = [0.0] * len(sources)
    for rank, i in enumerate(order):
        weights[i] = float(rank % 3 + 1)
    return weights


def fill(sizes: np.ndarray, copies: np.ndarray, gap: float) -> np.ndarray:
    """How many copies of each document fit the gap: taken in the order given while they fit, then exchanged to narrow what is left."""
    taken = np.zeros(len(sizes), np.int64)
    for i, (size, n) in enumerate(zip(sizes.tolist(), copies.tolist(), strict=True)):
        if 0 < size <= gap:
            taken[i] = min(n, int(gap // size))
            gap -= taken[i] * size
    for _ in range(EXCHANGES):  # one copy out, a larger one in
        out, free = np.nonzero(taken > 0)[0], np.nonzero((taken < copies) & (sizes > 0))[0]
        if gap < 1 or not len(out) or not len(free):
            break
        free = free[np.argsort(sizes[free], kind="stable")]
        at = np.searchsorted(sizes[free], sizes[out] + gap, side="right") - 1
        gain = np.where(at >= 0, sizes[free[np.maximum(at, 0)]] - sizes[out], 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        taken[out[best]] -= 1
        taken[free[at[best]]] += 1
        gap -= float(gain[best])
    return taken


class Plan:
    """What the mix takes of every row: a table per source, and one of the rows where a source's fractional repetitions end."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, source_col: str, weights, share: float, max_epochs: int, seed: int):
        self.id_col, self.text_col, self.source_col, self.max_epochs, self.seed = id_col, text_col, source_col, max_epochs, seed
        self.base = base = materialise(self.sized(df), "mix-sizes")
        stats = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
        rows = stats.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
        sizes = [r["source_size"] for r in rows]
        target = water_fill(sizes, weights([r["source"] for r in rows]), share * sum(sizes), max_epochs)
        made = []
        for r, t in zip(rows, target, strict=True):
            whole = min(int(math.floor(t / r["source_size"])), max_epochs) if r["source_size"] else 0
            bits = max(0, math.ceil(math.log2(max(1, r["n"] / BUCKET_ROWS))))
            made.append((r["source"], r["source_size"], float(t), whole, float(t - whole * r["source_size"]), bits))
        kinds = (("source_size", T.LongType()), ("target", T.DoubleType()), ("whole", T.IntegerType()), ("rest", T.DoubleType()), ("bits", T.IntegerType()))
        schema = T.StructType([T.StructField("p_source", df.schema[source_col].dataType), *(T.StructField(n, t) for n, t in kinds)])
        plan = df.sparkSession.createDataFrame(made, schema)
        placed = self.placed(base, plan)
        sums = placed.groupBy("p_source", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("rest").alias("rest"))
        upto = F.sum("bucket_size").over(W.partitionBy("p_source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow))
        edge = sums.withColumn("upto", upto).where((F.col("upto") - F.col("bucket_size") <= F.col("rest")) & (F.col("upto") > F.col("rest")))
        edge = materialise(edge.select(F.col("p_source").alias("e_source"), F.col("bucket").alias("edge"), (F.col("rest") - F.col("upto") + F.col("bucket_size")).alias("gap")), "mix-edges")
        self.plan = materialise(plan.join(edge, F.col("p_source").eqNullSafe(F.col("e_source")), "left").drop("e_source"), "mix-plan")
        self.ends = materialise(self._ends(self.placed(base, self.plan).where("bucket = edge")), "mix-ends")

    def sized(self, df: DataFrame) -> DataFrame:
        """(id, source, size, row, u) of df: the row's hash and the 63 seeded bits that order the rows of a source."""
        rows = df.select(F.col(f"`{self.id_col}`").alias("id"), F.col(f"`{self.source_col}`").alias("source"), word_count(F.col(f"`{self.text_col}`")).alias("size"), row_hash(df).alias("row"))
        return rows.withColumn("u", F.shiftrightunsigned(F.xxhash64("row", F.lit(self.seed)), 1))

    @staticmethod
    def placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
        """rows with their source's plan; the leading bits of u are the bucket, so buckets follow the order of u."""
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source")))
        return joined.withColumn("bucket", F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftright(u, 63 - bits)")))

    @staticmethod
    def _ends(rows: DataFrame) -> DataFrame:
        """(row, copies, extra): of the rows in the bucket where a source's rest ends, how many copies are taken."""
        python_ready(rows.sparkSession)
        groups = rows.groupBy("p_source", "gap", "row", "u", "size").agg(F.count("*").alias("copies"))

        def choose(group: pa.Table) -> pa.Table:
            order = np.lexsort((group["size"].to_numpy(), group["u"].to_numpy()))
            group = group.take(pa.array(order))
            taken = fill(group["size"].to_numpy(), group["copies"].to_numpy(), float(group["gap"][0].as_py()))
            return group.select(["row", "copies"]).append_column("extra", pa.array(taken))

        return groups.groupBy("p_source").applyInArrow(choose, "row struct<a:bigint,b:bigint>, copies bigint, extra bigint")

    def of(self, rows: DataFrame) -> DataFrame:
        """rows (of `sized`) with source_size, target and, over all equal rows, copies and extra; both are 1 and the decision itself for most rows."""
        ends = self.ends.select(F.col("row").alias("e_row"), "copies", F.col("extra").alias("taken_copies"))
        placed = self.placed(rows, self.plan)
        joined = placed.join(few(ends), F.col("row") == F.col("e_row"), "left")
        inside = F.coalesce(F.col("bucket") < F.col("edge"), F.lit(False)).cast("long")
        return joined.withColumns({"extra": F.coalesce("taken_copies", inside), "copies": F.coalesce("copies", F.lit(1))}).drop("e_row", "taken_copies")


def _repeats(whole, extra, size, most: int):
    return F.when(size == 0, whole).otherwise(F.least(whole + extra, F.lit(most))).cast("int")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cyclic_weights, share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """Decide how often each document is repeated so that sources meet their target words.

    Two passes: one reads the texts and writes (id, source, size, hashes); the
    per-source totals (one row per source, at most MOST_SOURCES) feed
    `water_fill` on the driver. A source of r epochs repeats every document
    floor(r) times; the fractional rest goes to documents in the order of a
    seeded hash of the whole row until it is used up. The place where it ends
    is found from sums per hash bucket; only the bucket that holds it (about
    BUCKET_ROWS different rows) is sorted, so a source with a third of all rows
    never comes to one task. There documents are taken while they fit and then
    exchanged to narrow the gap (`fill`), so a source ends at most a few words
    below its target wherever sizes allow it.

    Nulls: a null text has size 0; null sources form one source, last in
    order; null ids are like any value. Empty sources get target 0. Very long
    texts count whole; one that is larger than its source's rest is skipped.
    Equal rows are one place in the order, of which any copies may be taken.
    Columns of df only tell rows apart. An empty table gives no rows.
    Returns id, size, source, source_size, target, repeats, taken.
    """
    plan = Plan(df, id_col, text_col, source_col, weights, share, max_epochs, seed)
    found = plan.of(plan.base)
    # of equal rows the first `extra` get one more, by their number; other rows have copies = 1
    single = found.where("copies = 1").withColumn("more", F.col("extra"))
    equal = found.where("copies > 1").withColumn("nth", F.row_number().over(W.partitionBy("row").orderBy("u")))
    each = F.floor(F.col("extra") / F.col("copies")) + (F.col("nth") <= F.col("extra") % F.col("copies")).cast("long")
    both = single.unionByName(equal.withColumn("more", each).drop("nth"))
    repeats = _repeats(F.col("whole"), F.col("more"), F.col("size"), max_epochs)
    out = both.withColumn("repeats", repeats)
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=cyclic_weights, share: float = 1.0, max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each row of df as often as `mix` says, with its number `repetition` from 1.

    The decision is a function of the row's source and hash but where a
    source's rest ends; those few rows are looked up, so no text is shuffled.
    Of equal rows beside that place one stands for all and is repeated as
    often as they are together. Rows that the mix takes no times are absent.
    Columns of df keep their names; a column `repetition` of df is an error.
    Nulls, long texts, ties and empty tables as in `mix`.
    """
    if "repetition" in df.columns:
        raise ValueError("result column 'repetition' would hide a column of the input: rename it first")
    plan = Plan(df, id_col, text_col, source_col, weights, share, max_epochs, seed)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__all"), word_count(F.col(f"`{text_col}`")).alias("size"), F.col(f"`{source_col}`").alias("source"), row_hash(df).alias("row"))
    found = plan.of(packed.withColumn("u", F.shiftrightunsigned(F.xxhash64("row", F.lit(seed)), 1)))
    single = found.where("copies = 1").withColumn("times", _repeats(F.col("whole"), F.col("extra"), F.col("size"), max_epochs))
    total = F.col("whole") * F.col("copies") + F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("extra"))
    equal = found.where("copies > 1").dropDuplicates(["row"]).withColumn("times", total.cast("int"))
    both = single.unionByName(equal).where("times > 0")
    return both.select("__all.*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("repetition"))


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "repeats", "source")
