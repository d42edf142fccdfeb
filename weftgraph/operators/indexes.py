"""Search tables: vectors in cells of near ones, and words of names in sorted postings."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from weftgraph.functions import vectors as V
from weftgraph.operators.joins import HOT_ROWS
from weftgraph.session import materialise, scratch_path, ship_package

#: Cells of a vector index at most, vectors that its centres are fitted on, and queries that are broadcast.
CELLS, FIT_ROWS, BROADCAST_QUERIES = 1024, 20_000, 20_000
#: Rows whose neighbours are looked up to choose how many cells a search opens, how many neighbours of each, and the share of them to be found.
TRIAL_ROWS, TRIAL_NEIGHBOURS, RECALL = 64, 10, 0.97
#: Pairs from which a search multiplies blocks of rows and queries, rows and queries of a block about, queries of one product, pairs of a task about, and the greatest norm for which no product overflows.
PRODUCT_PAIRS, BLOCK_ROWS, BLOCK_QUERIES, STRIP, TASK_PAIRS, GREATEST = 200_000, 4096, 2048, 128, 50_000_000, 1e150


def unit(v):
    """A vector as a list of doubles of length 1; a null or zero vector has none."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 1e-9, F.transform(d, lambda x: x / norm))


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def _angle(cosine):
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))


def millionths(cos: np.ndarray) -> np.ndarray:
    """Cosines as rounded to six decimals, half away from zero by their decimal digits, times 10^6."""
    y = np.abs(cos) * 1e6
    r = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6).tolist():
        r[i] = int(Decimal(repr(float(abs(cos[i])))).scaleb(6).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(r, cos) + 0.0


def best_of_block(q: np.ndarray, q_norm: np.ndarray, v: np.ndarray, norm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k rows of highest rounded cosine of each query, ties by the row's place.

    A matrix product rules out what is behind the k-th by more than rounding
    can change; the others' cosines are summed up in the order of the
    components, as the expression on columns does.
    """
    scale = lambda n: np.where(n < 1e-9, 0.0, 1 / np.maximum(n, 1e-9))[:, None]
    turn, out = np.ascontiguousarray((v * scale(norm)).T), []
    units, columns = q * scale(q_norm), np.ascontiguousarray(v.T)
    for at in range(0, len(q), STRIP):
        near = units[at : at + STRIP] @ turn
        if len(v) > k:
            x, y = np.nonzero(near >= np.partition(near, len(v) - k, axis=1)[:, len(v) - k, None] - 2e-6)
        else:
            x, y = (i.ravel() for i in np.indices(near.shape))
        x = x + at
        total = np.zeros(len(x))
        for j in range(v.shape[1]):
            total += columns[j][y] * q[x, j]
        flat = (norm[y] < 1e-9) | (q_norm[x] < 1e-9)
        cos = np.where(flat, 0.0, np.clip(total / np.where(flat, 1.0, norm[y] * q_norm[x]), -1.0, 1.0))
        order = np.lexsort((y, -millionths(cos), x))
        x, y, cos = x[order], y[order], cos[order]
        first = np.searchsorted(x, x)
        top = np.arange(len(x)) - first < k
        out.append((x[top], y[top], cos[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class VectorIndex:
    """An inverted file: every vector stands in the partition of its nearest centre.

    A search opens the cells of the nearest centres alone, which is
    partition pruning of the written table, and ranks what it finds by exact
    cosines. An exact search then opens those of the other cells that can
    still hold something better: in a cell whose vectors lie within an angle r
    of the centre, none is nearer to the query than its angle to the centre
    less r.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, vectors: DataFrame, path: str | None = None, cells: int | None = None, key: str = "name", vec: str = "q_vector", seed: int = 42) -> VectorIndex:
        """Index every row (key, vec) of vectors. Centres are fitted on about FIT_ROWS rows, chosen by a hash of the key; their number is the root of the row count, CELLS at most.

        Rows with a null or zero vector have no direction: they stand in the
        cell -1, which only exact searches open. A cell with many rows is
        written by several tasks.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        out = cls(spark, path or scratch_path(spark, "vector-index"))
        rows = vectors.select(F.col(key).alias("name"), F.col(vec).cast("array<double>").alias("v"), unit(F.col(vec)).alias("u"), V.norm(F.col(vec).cast("array<double>")).alias("norm"))
        n = rows.count()
        fit = rows.where("u is not null")
        if n > FIT_ROWS:
            fit = fit.where(F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(1 << 30)) < int(FIT_ROWS / n * (1 << 30)))
        fit = materialise(fit.select("u"), "index-fit")
        k = max(2, min(cells or min(CELLS, int(n**0.5)), fit.count()))
        near, centres = rows.where("u is not null"), []
        if not fit.isEmpty():
            model = KMeans(k=k, distanceMeasure="cosine", seed=seed, featuresCol="f", predictionCol="cell", maxIter=15).fit(fit.select(array_to_vector("u").alias("f")))
            centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
            near = model.transform(near.withColumn("f", array_to_vector("u")))
        table = materialise(spark.createDataFrame(centres, "cell int, centre array<double>").select("cell", unit(F.col("centre")).alias("centre")), "index-centres")
        # a cell's radius is that of its rows, whichever centre they were given
        placed = near.join(F.broadcast(table), "cell") if centres else rows.where("false").withColumns({"cell": F.lit(0), "centre": F.col("u")})
        placed = placed.select("name", "v", "norm", "cell", _angle(_dot("u", "centre")).alias("angle")).unionByName(rows.where("u is null").select("name", "v", "norm", F.lit(-1).alias("cell"), F.lit(0.0).alias("angle")))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1_000_000)
        placed.repartition(parts, "cell", F.pmod(F.xxhash64("name"), F.lit(max(1, n // (k * HOT_ROWS))))).write.partitionBy("cell").parquet(f"{out.path}/rows")
        sizes = out.rows().groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        sizes.join(F.broadcast(table), "cell", "left").coalesce(1).write.parquet(f"{out.path}/cells")
        cosine = V.cosine_of(V.dot(F.col("v"), F.col("q_vec")), F.col("norm"), F.col("q_norm"))
        trial = placed.where(F.pmod(F.xxhash64("name", F.lit(seed + 1)), F.lit(1 << 30)) < int(min(1.0, TRIAL_ROWS / max(n, 1)) * (1 << 30))) if n > TRIAL_ROWS else placed
        trial = materialise(trial.where("cell >= 0").select(F.col("name").alias("q_name"), F.col("v").alias("q_vec")), "index-trial")
        order = F.row_number().over(W.partitionBy("q_name").orderBy(F.desc("cos"), "name"))
        near = out.rows().where("cell >= 0").join(F.broadcast(trial.withColumn("q_norm", V.norm(F.col("q_vec")))), F.col("name") != F.col("q_name")).select("q_name", "name", "cell", cosine.alias("cos"))
        near = near.withColumn("place", order).where(F.col("place") <= TRIAL_NEIGHBOURS).join(out.bounds(trial), ["q_name", "cell"])
        near.agg(F.coalesce(F.ceil(F.percentile("rank", F.lit(RECALL))), F.lit(1)).cast("int").alias("probes")).coalesce(1).write.parquet(f"{out.path}/probes")
        return out

    @cached_property
    def probes(self) -> int:
        """The cells that a search opens: as many as found the share RECALL of the neighbours of some rows of this index."""
        return self.spark.read.schema("probes int").parquet(f"{self.path}/probes").first()["probes"]

    def rows(self) -> DataFrame:
        return self.spark.read.schema("name string, v array<double>, norm double, angle double, cell int").parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        """(cell, n, radius, centre); CELLS rows and the cell -1 at most."""
        return self.spark.read.schema("cell int, n long, radius double, centre array<double>").parquet(f"{self.path}/cells")

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(q_name, cell, n, most, rank): the greatest cosine that a cell can hold for each query, and its place by the distance of the centre."""
        pairs = queries.select("q_name", unit(F.col("q_vec")).alias("qu")).join(F.broadcast(self.cells()))
        angle = _angle(_dot("qu", "centre"))
        pairs = pairs.select("q_name", "cell", "n", angle.alias("angle"), F.when(F.col("centre").isNotNull() & F.col("qu").isNotNull(), F.cos(F.greatest(F.lit(0.0), angle - F.col("radius")))).otherwise(0.0).alias("most"))
        return pairs.withColumn("rank", F.row_number().over(W.partitionBy("q_name").orderBy(F.col("angle").asc_nulls_last(), "cell")))

    def _within(self, queries: DataFrame, opened: DataFrame, k: int) -> DataFrame:
        """(q_name, name, cos) of the rows in the cells opened (q_name, cell, n) for each query; of many, those that can be among its k best."""
        asked = queries.select("q_name", "q_vec", V.norm(F.col("q_vec")).alias("q_norm"))
        opened = materialise(opened.select("q_name", "cell", "n"), "index-opened")
        ids = [r["cell"] for r in opened.select("cell").distinct().collect()]  # CELLS at most; the scan lists these folders alone
        rows = self.rows().where(F.col("cell").isin(ids))
        size = opened.agg(F.count("*").alias("opened"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")).first()
        if size["pairs"] < PRODUCT_PAIRS:
            return self._paired(rows, asked, opened, size["opened"])
        width = (rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first() or [0])["w"]

        def plain(v: str, norm: str):
            return F.coalesce((F.size(v) == width) & (F.col(norm) < GREATEST) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(False))

        asked = materialise(asked.withColumn("q_vec", F.col("q_vec").cast("array<double>")).withColumn("plain", plain("q_vec", "q_norm")), "index-asked")
        found = [self._products(rows.where(plain("v", "norm")), asked.where("plain").drop("plain"), opened, k, width, size["pairs"])]
        # vectors of another width, or with nulls or numbers too great, are few: pair by pair
        odd, strange = rows.where(~plain("v", "norm")), asked.where("not plain").drop("plain")
        if not odd.isEmpty():
            found.append(self._paired(odd, asked.drop("plain"), opened, size["opened"]))
        if not strange.isEmpty():
            found.append(self._paired(rows.where(plain("v", "norm")), strange, opened, size["opened"]))
        return reduce(DataFrame.unionByName, found)

    def _paired(self, rows: DataFrame, asked: DataFrame, opened: DataFrame, n: int) -> DataFrame:
        opened = opened.drop("n").join(asked, "q_name")
        few = F.broadcast(opened) if n <= BROADCAST_QUERIES else opened
        return rows.join(few, "cell").select("q_name", "name", F.round(V.cosine_of(V.dot(F.col("v"), F.col("q_vec")), F.col("norm"), F.col("q_norm")), 6).alias("cos"))

    def _products(self, rows: DataFrame, asked: DataFrame, opened: DataFrame, k: int, width: int, pairs: int) -> DataFrame:
        """`_within` by matrix products: a cell's rows in blocks meet the queries that open it in blocks, and each query keeps the k best of a block.

        No pair is a row; a task holds two blocks. Work is that of the pairs,
        what is shuffled that of rows and opened cells.
        """
        ship_package(self.spark)
        q_parts = max(1, -(-asked.count() // BLOCK_QUERIES))
        tasks = min(10_000, max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS))
        key = ["cell", "r_part", "q_part"]
        blocks = F.broadcast(self.cells().select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks")))
        parts = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        left = rows.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("r_part"), parts(F.lit(q_parts)).alias("q_part"), "name", "v", "norm")
        right = opened.join(blocks, "cell").select("q_name", "cell", parts(F.col("blocks")).alias("r_part")).join(asked, "q_name").withColumn("q_part", F.pmod(F.xxhash64("q_name"), F.lit(q_parts)).cast("int"))
        left, right = (side.repartition(tasks, *key).groupBy(*key) for side in (left, right))

        def matrix(t: pa.Table, column: str) -> np.ndarray:
            return np.asarray(t.column(column).combine_chunks().flatten()).reshape(len(t), width)

        def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            if not len(mine) or not len(theirs):
                return pa.table({"q_name": theirs.column("q_name")[:0], "name": pa.array([], pa.string()), "cos": pa.array([], pa.float64())})
            # in the order of names, so that places order ties
            mine = mine.take(pc.sort_indices(mine, sort_keys=[("name", "ascending")], null_placement="at_start"))
            x, y, cos = best_of_block(matrix(theirs, "q_vec"), theirs.column("q_norm").to_numpy(), matrix(mine, "v"), mine.column("norm").to_numpy(), k)
            return pa.table({"q_name": theirs.column("q_name").take(pa.array(x)), "name": mine.column("name").take(pa.array(y)), "cos": pa.array(cos)})

        kind = asked.schema["q_name"].dataType.simpleString()
        found = left.cogroup(right).applyInArrow(best, f"q_name {kind}, name string, cos double")
        return found.withColumn("cos", F.round("cos", 6))

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(q_name, name, cos, rank): the k rows of highest cosine of each query (q_name, q_vec), ties by name.

        Approximate searches look into the nearest cells, as many as building
        the index found to be enough or as `probes` says; exact ones find what
        a scan of all rows finds.
        """
        probes = probes or self.probes
        bounds = materialise(self.bounds(queries), "index-bounds")
        found = self._within(queries, bounds.where((F.col("rank") <= probes) & (F.col("cell") >= 0)), k)
        best = F.row_number().over(W.partitionBy("q_name").orderBy(F.desc("cos"), "name"))
        if exact:
            found = materialise(found.withColumn("rank", best).where(F.col("rank") <= k).drop("rank"), "index-found")
            full = found.groupBy("q_name").agg(F.count("*").alias("found"), F.min("cos").alias("least"))
            rest = bounds.where((F.col("rank") > probes) | (F.col("cell") < 0)).join(full, "q_name", "left")
            # cosines are compared as they are rounded
            rest = rest.where((F.coalesce("found", F.lit(0)) < k) | (F.col("most") + 1e-6 >= F.col("least")))
            found = found.unionByName(self._within(queries, rest, k))
        return found.withColumn("rank", best).where(F.col("rank") <= k)

    def scanned(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(q_name, rows, share): the rows that an approximate search reads for each query, and their share of all."""
        probes = probes or self.probes
        total = self.cells().agg(F.sum("n").alias("total"))
        read = self.bounds(queries).where((F.col("rank") <= probes) & (F.col("cell") >= 0)).groupBy("q_name").agg(F.sum("n").alias("rows"))
        return read.join(F.broadcast(total)).select("q_name", "rows", (F.col("rows") / F.col("total")).alias("share"))


class NameIndex:
    """Words of names in postings sorted by word: a prefix is a range, and only row groups that hold it are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, entities: DataFrame, path: str | None = None, parts: int | None = None) -> NameIndex:
        """Index the words (letters and digits, case folded) of entities (kg_id, name); a word in very many names is split by name."""
        spark = entities.sparkSession
        out = cls(spark, path or scratch_path(spark, "name-index"))
        words = F.explode(F.array_distinct(F.split(F.lower("name"), r"[^\p{L}\p{N}]+")))
        rows = entities.select("kg_id", "name", words.alias("word")).where("word <> ''")
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(parts, "word", "kg_id", "name").sortWithinPartitions("word", "kg_id", "name").write.parquet(out.path)
        return out

    def postings(self, terms: list[str]) -> DataFrame:
        """(kg_id, name, word) of the words that start with any term; each prefix reaches the scan as a range."""
        rows = self.spark.read.schema("kg_id long, name string, word string").parquet(self.path)
        wanted = [t for t in dict.fromkeys(t.lower() for t in terms) if t]
        hit = F.lit(False)
        for t in wanted:
            hit = F.col("word").startswith(t) if t == wanted[0] else hit | F.col("word").startswith(t)
        return rows.where(hit)

    def search(self, terms: list[str], kg: int | None = None) -> DataFrame:
        """(kg_id, name, terms): entities with a word that starts with any term, and how many of the terms they have."""
        wanted = [t for t in dict.fromkeys(t.lower() for t in terms) if t]
        rows = self.postings(wanted)
        if kg is not None:
            rows = rows.where(F.col("kg_id") == kg)
        which = F.explode(F.array_compact(F.array(*[F.when(F.col("word").startswith(t), F.lit(t)) for t in wanted]))) if wanted else F.lit(None).cast(T.StringType())
        return rows.select("kg_id", "name", which.alias("term")).groupBy("kg_id", "name").agg(F.countDistinct("term").alias("terms"))
