"""Second-order random walks over tables, and vectors of the nodes they visit."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.operators.joins import HOT_KEYS, HOT_ROWS, spread_join
from weftgraph.session import free_shuffles, materialise, ship_package, temporary

#: Rounds between two written tables; neighbours that one task numbers together, about.
ROUNDS, BUCKET = 5, 4096
#: Word2Vec holds all vectors on the driver: used up to this many numbers. Beyond it, coordinates that a context adds to.
NUMBERS, SPOTS = 1 << 24, 16
#: Walks whose contexts a task counts, about, nodes up to which the contexts' sums are broadcast, and rows of a batch that a task hands on.
TASK_WALKS, MASSES, BATCH = 10_000, 1 << 20, 200_000


def _kind(edges: DataFrame) -> str:
    """Nodes are whole numbers if both ends are, else strings."""
    return "long" if {edges.schema[c].dataType.typeName() for c in "ab"} <= {"byte", "short", "integer", "long"} else "string"


def numbered(edges: DataFrame) -> DataFrame:
    """(node, pos, other, degree, other_degree): the distinct neighbours of each node of undirected pairs (a, b), numbered from 0.

    A node's neighbours are numbered in buckets of about BUCKET by their hash,
    whose sizes are summed up, so no task orders all neighbours of a hub.
    Pairs with a null end are left out; a loop makes a node its own neighbour.
    """
    kind = _kind(edges)
    pairs = edges.where("a is not null and b is not null").select(F.col("a").cast(kind).alias("node"), F.col("b").cast(kind).alias("other"))
    both = materialise(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "walk-pairs")
    degrees = both.groupBy("node").agg(F.count("*").alias("degree")).withColumn("rows", F.col("degree"))
    known = spread_join(both, degrees, ["node"], "rows").withColumn("bucket", F.pmod(F.xxhash64("other"), F.ceil(F.col("degree") / BUCKET)))
    sizes = known.groupBy("node", "bucket").agg(F.count("*").alias("size"))
    before = F.sum("size").over(W.partitionBy("node").orderBy("bucket")) - F.col("size")
    place = F.row_number().over(W.partitionBy("node", "bucket").orderBy("other")) - 1
    placed = known.withColumn("place", place).join(sizes.select("node", "bucket", before.alias("before")), ["node", "bucket"])
    placed = placed.select("node", (F.col("before") + F.col("place")).alias("pos"), "other", "degree")
    ends = degrees.select(F.col("node").alias("other"), F.col("degree").alias("other_degree"), "rows")
    return spread_join(placed, ends, ["other"], "rows")


def advance(now: DataFrame, near: DataFrame, p: float, q: float, seed: int) -> DataFrame:
    """Walks after one round: each draws one neighbour and goes there, or rejects it and stays.

    A neighbour's weight is 1/p for the node the walk came from, 1 for a
    neighbour of that node, else 1/q. The way back is drawn apart by its
    share of the total bound; else all neighbours are proposed evenly, the
    way back is rejected, and the others are taken with their weight over
    the greatest of 1 and 1/q. Only a draw between
    1 and 1/q has to know whether the proposed node is a neighbour of the last.
    """
    tries = F.col("tries") if "tries" in now.columns else F.lit(0)
    draw = lambda salt: F.xxhash64("walk_id", "n", tries, F.lit(seed), F.lit(salt))
    share = lambda salt: F.pmod(draw(salt), F.lit(1 << 40)) / float(1 << 40)
    # the key (node, number) spreads a hub's walks over its neighbours' rows
    there = near.select(F.col("node").alias("at"), "pos", F.col("other").alias("to"), F.col("other_degree").alias("to_degree"))
    state = now.withColumn("pos", F.pmod(draw(0), F.col("degree"))).join(there, ["at", "pos"]).drop("pos")
    if p == 1.0 and q == 1.0:
        return state.select("walk_id", F.col("to").alias("at"), F.col("to_degree").alias("degree"), (F.col("n") + 1).alias("n"), F.array_append("part", F.col("to")).alias("part"))
    low, high = min(1.0, 1 / q), max(1.0, 1 / q)
    second = F.col("back").isNotNull()
    returns = second & ((F.col("degree") == 1) | (share(1) * (1 / p + high * F.col("degree")) < 1 / p))
    state = state.withColumn("returns", returns).withColumn("v", share(2) * high)
    state = state.withColumn("to", F.when(F.col("returns"), F.col("back")).otherwise(F.col("to"))).withColumn("to_degree", F.when(F.col("returns"), F.col("back_degree")).otherwise(F.col("to_degree")))
    taken = F.col("returns") | ~second
    if q == 1.0:
        return _moved(state, taken | (F.col("to") != F.col("back")))
    state = state.withColumn("asks", second & ~F.col("returns") & (F.col("to") != F.col("back")) & (F.col("v") >= low))
    # rows that ask nothing carry a key of their own, so they are spread as well
    state = state.withColumn("ask", F.when(F.col("asks"), F.col("back")).otherwise(F.col("walk_id")))
    pairs = near.select(F.col("node").alias("ask_node"), F.col("other").alias("ask_other"))
    state = state.join(pairs, F.col("asks") & (F.col("ask") == F.col("ask_node")) & (F.col("to") == F.col("ask_other")), "left")
    weight = F.when(F.col("ask_node").isNotNull(), 1.0).otherwise(1 / q)
    return _moved(state, taken | ((F.col("to") != F.col("back")) & ((F.col("v") < low) | (F.col("v") < weight))))


def _moved(state: DataFrame, taken: Column) -> DataFrame:
    state = state.withColumn("taken", F.coalesce(taken, F.lit(False)))
    go = lambda new, old: F.when(F.col("taken"), new).otherwise(old)
    return state.select(
        "walk_id", go(F.col("to"), F.col("at")).alias("at"), go(F.col("to_degree"), F.col("degree")).alias("degree"), go(F.col("at"), F.col("back")).alias("back"), go(F.col("degree"), F.col("back_degree")).alias("back_degree"),
        go(F.col("n") + 1, F.col("n")).alias("n"), go(F.lit(0), F.col("tries") + 1).alias("tries"), go(F.array_append("part", F.col("to")), F.col("part")).alias("part"),
    )


def walks(edges: DataFrame, per_node: int = 10, length: int = 40, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """(walk_id, nodes): `per_node` second-order random walks of `length` nodes from each node of undirected pairs (a, b).

    Every round joins the walks with one numbered neighbour each (`advance`);
    no neighbour list is gathered or carried, and a walk carries only what it
    visited since the last cut, and where it came from if p or q ask for it.
    Every ROUNDS rounds are one plan and a written table. Nodes that are whole
    numbers stay numbers. With q other than 1 a walk may stay some rounds, up to
    max(q, 1/q) on average; rounds go on until all walks are whole. Choices
    are hashes of walk, step and seed and don't depend on partitions.
    """
    spark = edges.sparkSession
    with temporary(spark) as kept:
        near = materialise(numbered(edges), "walk-near")
        starts = near.where("pos = 0").select("node", "degree", F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("k"))
        kind = _kind(edges)
        walk_id = F.col("node") * per_node + F.col("k") if kind == "long" else F.concat_ws("#", "node", "k")
        second = [] if p == q == 1.0 else [F.lit(None).cast(kind).alias("back"), F.lit(None).cast("long").alias("back_degree"), F.lit(0).alias("tries")]
        now = starts.select(walk_id.alias("walk_id"), F.col("node").alias("at"), "degree", *second, F.lit(1).alias("n"), F.array("node").alias("part"))
        parts, least = [], 1
        while least is not None:
            for _ in range(min(ROUNDS, length - least)):
                now = advance(now, near, p, q, seed)
            now = materialise(now, "walk-rounds")
            free_shuffles(spark)
            parts.append(now.select("walk_id", F.lit(len(parts)).alias("block"), "part"))
            now = now.where(F.col("n") < length)
            least = now.agg(F.min("n")).first()[0]
            now = now.withColumn("part", F.array().cast(f"array<{kind}>"))
        whole = reduce(DataFrame.unionByName, parts).groupBy("walk_id").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
        whole = whole.select("walk_id", F.slice(F.flatten(F.transform("parts", lambda x: x["part"])), 1, length).alias("nodes"))
        out = materialise(whole, "walks")
        free_shuffles(spark)
        kept.append(out)
    return out


def contexts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(node, context, n) of each batch of walks: how often two nodes stand up to `window` steps apart, in both directions."""
    for b in batches:
        walks_ = b.column(0)
        coded = walks_.flatten().dictionary_encode()
        at, walk = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(walks_)), walks_.value_lengths().to_numpy())
        pairs, nodes = [], len(coded.dictionary)
        for step in range(1, window + 1):
            same = walk[step:] == walk[:-step]
            one, two = at[:-step][same], at[step:][same]
            pairs += [one * nodes + two, two * nodes + one]
        pair, n = np.unique(np.concatenate(pairs), return_counts=True)
        for i in range(0, len(pair), BATCH):
            node, context = np.divmod(pair[i : i + BATCH], nodes)
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(node)), coded.dictionary.take(pa.array(context)), pa.array(n[i : i + BATCH])], names=["node", "context", "n"])


def spots(context: np.ndarray, spot: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, sign) of one of the SPOTS coordinates that contexts, given by their hashes, add to."""
    x = context.view(np.uint64) + np.uint64((spot + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(times)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(1)) % np.uint64(width), 1.0 - 2.0 * (x & np.uint64(1))


def projected(batches: Iterator[pa.RecordBatch], total: int, width: int) -> Iterator[pa.RecordBatch]:
    """(node, vector) from all rows (node, context, n, context_mass, mass) of a task's nodes, contexts as hashes; a null mass is the sum of the node's rows."""
    given = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if given is None:
        return
    coded = given.column("node").combine_chunks().dictionary_encode()
    at, context, n, context_mass = (np.asarray(c) for c in (coded.indices, *(given.column(c) for c in ("context", "n", "context_mass"))))
    k, at = len(coded.dictionary), at.astype(np.int64)
    mass = np.bincount(at, n, k)
    known = given.column("mass").combine_chunks()
    if known.null_count < len(known):
        mass[at] = np.where(np.asarray(known.is_null()), mass[at], np.asarray(known.fill_null(0)))
    order = np.lexsort((context, at))
    at, context, context_mass = at[order], context[order], context_mass[order]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (context[1:] != context[:-1])])
    at, context, n = at[first], context[first], np.add.reduceat(n[order], first)
    x = np.log(n * float(total) / mass[at] / context_mass[first])
    told = x > 0
    at, context, x = at[told], context[told], x[told]
    sums = np.zeros(k * width)
    for s in range(SPOTS):
        spot, sign = spots(context, s, width)
        sums += np.bincount(at * width + spot.astype(np.int64), sign * x, k * width)
    sums /= SPOTS**0.5
    some = max(1, BATCH // width)
    for i in range(0, k, some):
        values = sums[i * width : (i + some) * width]
        yield pa.RecordBatch.from_arrays([coded.dictionary[i : i + some], pa.ListArray.from_arrays(np.arange(0, len(values) + 1, width, dtype=np.int32), values)], names=["node", "vector"])


def context_sketch(walked: DataFrame, width: int, window: int, seed: int) -> DataFrame:
    """(name, vector): each node's positive mutual information with the nodes up to `window` steps away, projected to `width` numbers.

    What skip-gram vectors factorise, by a sparse random projection: each
    context adds to SPOTS signed coordinates given by its hash. Cosines are
    kept about. How many contexts a node has follows from the walks' lengths;
    a node and its contexts are counted in the batches of walks and shuffled
    once, to the task that projects the node, and are not written. A node with
    very many is projected in parts by its contexts, whose vectors are summed.
    """
    spark = walked.sparkSession
    ship_package(spark)
    kind = walked.schema["nodes"].dataType.elementType.simpleString()
    # written walks are small files of many contexts: tasks are as many as the walks ask for
    tasks = min(10_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-walked.count() // TASK_WALKS)))
    at = walked.select(F.size("nodes").alias("length"), F.posexplode("nodes").alias("i", "node"))
    around = F.least("i", F.lit(window)) + F.least(F.col("length") - F.col("i") - 1, F.lit(window))
    mass = materialise(at.groupBy("node").agg(F.sum(around).alias("mass")).where("mass > 0"), "walk-mass")
    total, nodes, most = mass.agg(F.coalesce(F.sum("mass"), F.lit(0)), F.count("*"), F.coalesce(F.max("mass"), F.lit(0))).first()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    pairs = walked.select(F.xxhash64("nodes").alias("walk"), "nodes").repartition(tasks, "walk").select("nodes").mapInArrow(lambda b: contexts(b, window), f"node {kind}, context {kind}, n long")

    crowded = mass.where(F.col("mass") > limit)
    if most > limit:
        pairs = pairs.join(F.broadcast(crowded), "node", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("context"), F.ceil(F.col("mass") / limit)), F.lit(0)))
    else:
        pairs = pairs.withColumn("mass", F.lit(None).cast("long")).withColumn("part", F.lit(0))
    beside = mass.select(F.col("node").alias("context"), F.col("mass").alias("context_mass"))
    if nodes <= MASSES:
        met = pairs.repartition(tasks, "node", "part").join(F.broadcast(beside), "context")
    else:
        met = spread_join(pairs, beside.withColumn("rows", F.col("context_mass")), ["context"], "rows", total).repartition(tasks, "node", "part")
    met = met.select("node", F.xxhash64("context", F.lit(seed)).alias("context"), "n", "context_mass", "mass")
    out = materialise(met.mapInArrow(lambda b: projected(b, total, width), f"node {kind}, vector array<double>"), "walk-contexts")
    free_shuffles(spark)
    if most > limit:
        many = out.join(F.broadcast(crowded.select("node")), "node").select("node", F.posexplode("vector").alias("at", "x")).groupBy("node", "at").agg(F.sum("x").alias("x"))
        sums = many.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("node", F.transform("v", lambda x: x["x"]).alias("vector"))
        out = out.join(F.broadcast(crowded.select("node")), "node", "left_anti").unionByName(sums)
    return out.select(F.col("node").alias("name"), "vector")


def walk_vectors(walked: DataFrame, width: int = 384, window: int = 5, seed: int = 42, epochs: int = 5, numbers: int = NUMBERS) -> DataFrame:
    """(name, vector): vectors of the nodes of walks, near for nodes that are visited together.

    Skip-gram vectors (Word2Vec, fitted on several partitions) while all of
    them are at most `numbers` numbers, as the driver holds them;
    `context_sketch` for any more. No walks give no rows.
    """
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    n_nodes = walked.select(F.explode("nodes").alias("node")).agg(F.countDistinct("node")).first()[0]
    if not n_nodes:
        return walked.select(F.lit("").alias("name"), F.array().cast("array<double>").alias("vector")).limit(0)
    if n_nodes * width > numbers:
        return context_sketch(walked, width, window, seed).withColumn("name", F.col("name").cast("string"))
    walked = walked.withColumn("nodes", F.col("nodes").cast("array<string>"))
    parts = max(2, min(32, walked.count() // 5000))
    model = Word2Vec(vectorSize=width, windowSize=window, minCount=1, seed=seed, numPartitions=parts, maxIter=epochs, inputCol="nodes", outputCol="v").fit(walked)
    return model.getVectors().select(F.col("word").alias("name"), vector_to_array("vector").alias("vector"))
