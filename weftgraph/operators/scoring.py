"""Concept matching: weighted scores, nearest concepts, routes, centroids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.functions.vectors import alignment, cosine_of, dot, magnitude, norm
from weftgraph.operators.joins import spread_join
from weftgraph.operators.selfjoin import similar_pairs
from weftgraph.session import materialise

#: Concepts of one owner in a part, and pairs that a task makes, about.
PART, TASK_PAIRS = 1_000, 2_000_000


def pairs(queries: DataFrame, concepts: DataFrame, floor: float | None = C.COS_FLOOR) -> DataFrame:
    """Query concepts against concepts with their cosine; the query side is one question's concepts (at most 8), so it is broadcast.

    queries: (q_name, q_vec, q_interest, q_professional); concepts: any with q_vector.
    """
    q = F.broadcast(queries.withColumn("q_norm", norm(F.col("q_vec"))))
    out = concepts.withColumn("c_norm", norm(F.col("q_vector"))).join(q, F.lit(True))
    out = out.withColumn("cos", cosine_of(dot(F.col("q_vector"), F.col("q_vec")), F.col("c_norm"), F.col("q_norm"))).drop("c_norm", "q_norm")
    return out if floor is None else out.where(F.col("cos") >= floor)


def match_scores(queries: DataFrame, links: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(owner, score): sum of cos * alignment * magnitude over the sum of magnitudes, for pairs with enough cosine; 4 decimals."""
    p = pairs(queries, links)
    weigh = (F.col("q_interest"), F.col("q_professional"), F.col("interest"), F.col("professional"))
    p = p.withColumns({"mag": magnitude(*weigh), "part": F.col("cos") * alignment(*weigh) * magnitude(*weigh)})
    total = p.groupBy(owner).agg(F.sum("part").alias("part"), F.sum("mag").alias("mag"))
    return total.select(owner, F.when(F.col("mag") < 1e-9, F.lit(0.0)).otherwise(F.round(F.col("part") / F.col("mag"), 4)).alias("score"))


def matched_concepts(queries: DataFrame, links: DataFrame, owner: str = "owner_id", least: float = C.MATCH_COS, top: int = C.MATCH_TOP) -> DataFrame:
    """(owner, name, cos, rank): concepts whose best cosine passes `least`, the top ones per owner."""
    best = pairs(queries, links).where(F.col("cos") > least).groupBy(owner, "name").agg(F.round(F.max("cos"), 6).alias("cos"))
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc("cos"), "name"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)


def nearest(queries: DataFrame, concepts: DataFrame, k: int = C.COARSE_K) -> DataFrame:
    """(q_name, name, cos, rank): the k concepts of highest cosine per query concept, exact."""
    p = pairs(queries, concepts.select("name", "q_vector"), floor=None).select("q_name", "name", F.round("cos", 6).alias("cos"))
    return p.withColumn("rank", F.row_number().over(W.partitionBy("q_name").orderBy(F.desc("cos"), "name"))).where(F.col("rank") <= k)


def two_stage(queries: DataFrame, concepts: DataFrame, links: DataFrame, k: int = C.COARSE_K, least: float = C.ROUTE_MIN, top: int | None = C.ROUTE_TOP, search: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Routes: candidates are the k nearest concepts of any query concept; owners are scored on those alone.

    `search` finds the nearest ones (an index's search); without it all concepts are scanned.
    """
    candidates = (nearest(queries, concepts, k) if search is None else search(queries, k)).select("name").distinct()
    scored = match_scores(queries, links.join(candidates, "name", "left_semi")).where(F.col("score") >= least)
    scored = scored.orderBy(F.desc("score"), "owner_id")
    return scored if top is None else scored.limit(top)


def classified(queries: DataFrame, links: DataFrame, auto: float = C.CLASSIFY_AUTO) -> DataFrame:
    """(owner_id, score, status) of the best candidate: assigned from `auto`, else pending; unmatched below the minimum."""
    best = match_scores(queries, links).orderBy(F.desc("score"), "owner_id").limit(1)
    status = F.when(F.col("score") >= auto, "assigned").when(F.col("score") >= C.CLASSIFY_MIN, "pending").otherwise("unmatched")
    return best.withColumn("status", status)


def mean_vectors(df: DataFrame, owner: str, vector: str = "q_vector", digits: int = 6) -> DataFrame:
    """(owner, centroid): element-wise mean; sums per position combine on the map side."""
    at = df.select(owner, F.posexplode(vector).alias("pos", "x")).groupBy(owner, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = at.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return packed.select(owner, F.transform("v", lambda e: F.round(e["x"], digits)).alias("centroid"))


def pair_similarity(centroids: DataFrame, owner: str, least: float) -> DataFrame:
    """(a, b, sim) of all pairs a < b of owners whose centroids have a cosine of at least `least`."""
    return similar_pairs(centroids, owner, "centroid", least)


def mean_pair_cosine(vectors: DataFrame, group: str, vector: str = "q_vector") -> DataFrame:
    """(group, similarity): mean cosine over all pairs of different rows of each group, without listing them.

    For unit vectors the pairs' sum is (|sum of all|^2 - their number) / 2;
    vectors without length have cosine 0 with all. One aggregate by group and
    position; groups of one row have none.
    """
    v = vectors.select(group, norm(F.col(vector)).alias("len"), F.col(vector).cast("array<double>").alias("v"))
    v = v.select(group, "len", F.when(F.col("len") >= 1e-9, F.transform("v", lambda x: x / F.col("len"))).alias("v"))
    count = v.groupBy(group).agg(F.count("*").alias("n"), F.count("v").alias("units"))
    cells = v.where("v is not null").select(group, F.posexplode("v").alias("pos", "x")).groupBy(group, "pos").agg(F.sum("x").alias("x"))
    square = cells.groupBy(group).agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    both = count.where("n > 1").join(square, group, "left")
    return both.select(group, (F.coalesce(F.col("square") - F.col("units"), F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def co_occurring(links: DataFrame, owner: str = "owner_id") -> DataFrame:
    """(a, b, n) of concept pairs of one owner, a < b, with the number of owners.

    The pairs are as many as the squares of the owners' concepts, so none is
    shuffled that needs no counting: a pair with a concept of one owner has
    that owner alone. An owner's concepts are dealt to parts that meet all of
    them, and the tasks are as many as the pairs ask for, not the input.
    """
    rows = materialise(links.select(owner, "name").where(F.col(owner).isNotNull() & F.col("name").isNotNull()).distinct(), "pairs-rows")
    total = rows.count()
    names = rows.groupBy("name").agg(F.count("*").alias("owners")).withColumn("rows", F.col("owners"))
    sizes = materialise(rows.groupBy(owner).agg(F.count("*").alias("size")).withColumn("rows", F.col("size")), "pairs-sizes")
    known = spread_join(spread_join(rows, names, ["name"], "rows", total), sizes, [owner], "rows", total)
    known = materialise(known.select(owner, "name", "owners", F.ceil(F.col("size") / PART).alias("parts")), "pairs-known")

    def met(side: DataFrame) -> DataFrame:
        pairs = side.groupBy(owner).agg(F.count("*").alias("n")).agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0
        tasks = int(min(10_000, max(1, pairs / 2 // TASK_PAIRS)))
        a = side.select(owner, F.col("name").alias("a"), F.col("owners").alias("owners_a"), F.pmod(F.xxhash64("name"), F.col("parts")).alias("part"))
        b = side.select(owner, F.col("name").alias("b"), F.col("owners").alias("owners_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        return a.repartition(tasks, owner, "part").join(b.repartition(tasks, owner, "part"), [owner, "part"]).where("a < b")

    lone = met(known).where("owners_a = 1 or owners_b = 1").select("a", "b", F.lit(1).cast("long").alias("n"))
    several = known.where("owners > 1")
    if several.isEmpty():
        return lone
    return lone.unionByName(met(several).groupBy("a", "b").agg(F.count("*").alias("n")))


def first_pairs(links: DataFrame, most: int, owner: str = "owner_id") -> DataFrame:
    """(a, b): the first `most` concept pairs of one owner, a < b, in order.

    Every concept before the last of one of its owners begins a pair, so the
    first `most` of these begin all pairs wanted. All concepts before one of
    them in an owner are of them too, so their places there are `most` at
    most, and those of the first `most` partners of each twice as many.
    """
    rows = links.select(owner, "name").where(F.col(owner).isNotNull() & F.col("name").isNotNull()).distinct()
    place = F.row_number().over(W.partitionBy(owner).orderBy("name"))
    rows = materialise(rows.withColumn("place", place).where(F.col("place") <= 2 * most).drop("place"), "pairs-heads")
    last = rows.groupBy(owner).agg(F.max("name").alias("last"))
    begin = rows.join(last, owner).where("name < last").select("name").distinct().orderBy("name").limit(most)
    own = rows.join(F.broadcast(begin), "name").select(owner, F.col("name").alias("a"))
    return rows.withColumnRenamed("name", "b").join(own, owner).where("a < b").select("a", "b").distinct().orderBy("a", "b").limit(most)
