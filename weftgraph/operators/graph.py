"""Graph operators on edge tables (kg_id, subject, rel_type, verb, object, ..., confidence, source_doc_id, created_at)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftgraph.functions import constants as C
from weftgraph.functions.vectors import decay
from weftgraph.operators import joins as J
from weftgraph.session import materialise

KEY = ("subject", "rel_type", "object", "source_doc_id")
FACT = ("subject", "subject_type", "rel_type", "verb", "object", "object_type")


def _both_ways(edges: DataFrame) -> DataFrame:
    there = edges.select("kg_id", F.col("subject").alias("node"), F.col("object").alias("other"))
    return there.unionByName(edges.select("kg_id", F.col("object").alias("node"), F.col("subject").alias("other")))


def undirected(edges: DataFrame) -> DataFrame:
    """(kg_id, node, other) of both directions, distinct."""
    return _both_ways(edges).distinct()


def names_containing(entities: DataFrame, terms: list[str]) -> DataFrame:
    """Entities whose name holds any term, case folded."""
    hit = F.lit(False)
    for t in terms:
        hit |= F.lower("name").contains(t.lower())
    return entities.where(hit)


def _starts(start: Column):
    return lambda word: word.startswith(start)


def names_with_prefix(entities: DataFrame, terms: list[str]) -> DataFrame:
    """Entities with a word of the name that starts with any term."""
    parts = F.split(F.lower("name"), r"[^\p{L}\p{N}]+")
    hit = F.lit(False)
    for t in terms:
        start = F.lit(t.lower())
        hit |= F.exists(parts, _starts(start))
    return entities.where(hit)


def seed_neighbours(edges: DataFrame, seeds: DataFrame, limit: int = C.SEED_NEIGHBOURS) -> DataFrame:
    """Seeds (kg_id, seed) and at most `limit` distinct neighbours of theirs per graph, by name."""
    near = undirected(edges).withColumnRenamed("node", "seed").join(seeds, ["kg_id", "seed"])
    near = near.select("kg_id", F.col("other").alias("seed")).distinct().join(seeds, ["kg_id", "seed"], "left_anti")
    near = near.withColumn("rn", F.row_number().over(W.partitionBy("kg_id").orderBy("seed"))).where(F.col("rn") <= limit).drop("rn")
    return seeds.select("kg_id", "seed").unionByName(near)


#: Rows of a frontier that are broadcast at most (about 100 bytes each); beyond it a frontier is joined by a shuffle.
FEW = 200_000


class Adjacency:
    """Rows (kg_id, node, ...) that frontiers (kg_id, seed, node) meet, whatever the share of one node is.

    A frontier of FEW rows at most is broadcast, so the rows stay where they
    are. A longer one is joined by a shuffle: the rows of a node with more than
    HOT_ROWS of them are numbered into parts of about that size by a hash of
    `split`, and a frontier row at such a node goes to each of its parts. The
    list of these nodes is broadcast; it has at most HOT_KEYS rows, because the
    limit is raised with `total`, a bound on the number of rows.
    """

    def __init__(self, rows: DataFrame, total: int, split: tuple[str, ...]):
        self.rows, self.split, self.limit = rows, split, max(J.HOT_ROWS, total // J.HOT_KEYS)
        self.all = total

    @cached_property
    def hubs(self) -> DataFrame | None:
        """(kg_id, node, parts) of the nodes with many rows; None if there are none."""
        if self.all <= self.limit:
            return None
        sizes = self.rows.groupBy("kg_id", "node").agg(F.count("*").alias("n")).where(F.col("n") > self.limit)
        found = materialise(sizes.select("kg_id", "node", F.ceil(F.col("n") / self.limit).cast("int").alias("parts")), "expand-hubs")
        return None if found.isEmpty() else found

    def _parts(self, df: DataFrame, part: Column) -> DataFrame:
        return df.join(F.broadcast(self.hubs), ["kg_id", "node"], "left").withColumn("part", part).drop("parts")

    def meet(self, at: DataFrame) -> DataFrame:
        """The join with `at`, a written table (kg_id, seed, node)."""
        if at.count() <= FEW:
            return self.rows.join(F.broadcast(at), ["kg_id", "node"])
        if self.hubs is None:
            return self.rows.join(at, ["kg_id", "node"])
        spread = self._parts(self.rows, F.coalesce(F.pmod(F.xxhash64(*self.split), F.col("parts")), F.lit(0)))
        each = self._parts(at, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
        return spread.join(each, ["kg_id", "node", "part"]).drop("part")


def reach(edges: DataFrame, seeds: DataFrame, steps: int) -> DataFrame:
    """(kg_id, seed, node) of all nodes at undirected distance `steps` or less from each seed, as a written table.

    The frontier keeps the seed; nodes already reached leave it by an anti
    join. A frontier of FEW rows at most goes to the edges themselves, so only
    what it meets is shuffled; the distinct neighbours of all nodes are
    written for the first longer one. Each frontier is written once, so a step
    adds a constant to the plan.
    """
    reached = frontier = materialise(seeds.select("kg_id", "seed", F.col("seed").alias("node")).distinct(), "expand-seeds")
    met = None
    for _ in range(steps):
        if met is None and frontier.count() <= FEW:
            step = _both_ways(edges).join(F.broadcast(frontier), ["kg_id", "node"])
        else:
            if met is None:
                near = materialise(undirected(edges), "expand-near")
                met = Adjacency(near, near.count(), ("other",))
            step = met.meet(frontier)
        step = step.select("kg_id", "seed", F.col("other").alias("node")).distinct()
        frontier = materialise(step.join(reached, ["kg_id", "seed", "node"], "left_anti"), "expand-frontier")
        reached = reached.unionByName(frontier)
    return reached


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("*", F.explode(F.array_distinct(F.array("subject", "object"))).alias("node"))


def expand(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(kg_id, seed, edge...) of all edges (one row per key) on undirected paths of at most `hops` edges from each seed.

    Those are the edges with an endpoint at distance hops - 1 or less, so only
    hops - 1 frontier joins run and paths are never listed.
    """
    met = Adjacency(_ends(edges), 2 * edges.count(), KEY)
    reached = reach(edges, seeds, hops - 1)
    # an edge is met twice where both ends are reached: it stays at its subject, so no edge is shuffled to be told from its like
    first = reached.join(edges.select("kg_id", F.col("subject").alias("node")).distinct(), ["kg_id", "node"], "left_semi")
    first = materialise(first.select("kg_id", "seed", F.col("node").alias("subject"), F.lit(True).alias("twice")), "expand-subjects")
    at = F.broadcast(first) if first.count() <= FEW else first
    return met.meet(reached).join(at, ["kg_id", "seed", "subject"], "left").where("node = subject or twice is null").select("kg_id", "seed", *[c for c in edges.columns if c != "kg_id"])


def beside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (one row per key) with an end among nodes (kg_id, node), each once: no row per node is made, so none is sorted out again."""
    few = nodes.select("kg_id", "node").distinct()
    few = materialise(few, "expand-beside")
    at = F.broadcast if few.count() <= FEW else lambda df: df
    subjects, objects = (at(few.select("kg_id", F.col("node").alias(end))) for end in ("subject", "object"))
    there = edges.join(subjects, ["kg_id", "subject"], "left_semi")
    return there.unionByName(edges.join(subjects, ["kg_id", "subject"], "left_anti").join(objects, ["kg_id", "object"], "left_semi"))


def seed_top(hits: DataFrame, limit: int = C.SEED_FACTS, min_conf: int = 1) -> DataFrame:
    """The `limit` edges of highest confidence per seed; the confidence filter comes after the expansion."""
    order = W.partitionBy("kg_id", "seed").orderBy(F.desc("confidence"), *KEY)
    return hits.where(F.col("confidence") >= min_conf).withColumn("seed_rank", F.row_number().over(order)).where(F.col("seed_rank") <= limit)


def expand_top(edges: DataFrame, seeds: DataFrame, hops: int, limit: int = C.SEED_FACTS, min_conf: int = 1) -> DataFrame:
    """What `seed_top` of `expand` returns, but no more than `limit` edges of a node reach the join.

    A seed's best edges are among the best of the nodes that it reaches, so
    each node's edges are ranked first, in the same order. Spark limits each
    group before that rank's shuffle: a hub moves `limit` rows per task.
    Where a seed reaches many nodes, only their best edges meet it first. An
    edge of a node is behind that node's best, so a node with `limit` different
    best edges of others before its own adds nothing, and no edge behind the
    last of these does.
    """
    order = [F.desc("confidence"), *KEY]
    reached = reach(edges, seeds, hops - 1)
    ends = _ends(edges.where(F.col("confidence") >= min_conf))
    few = reached.count() <= FEW
    if few:  # ranks of the nodes that matter alone
        ends = ends.join(F.broadcast(reached.select("kg_id", "node").distinct()), ["kg_id", "node"], "left_semi")
    best = ends.withColumn("rn", F.row_number().over(W.partitionBy("kg_id", "node").orderBy(*order))).where(F.col("rn") <= limit)
    if few:
        hits = best.drop("rn").join(reached, ["kg_id", "node"])
    else:
        best = materialise(best, "expand-best")
        place = F.struct((-F.col("confidence")).alias("c"), *KEY)
        met = reached.join(best.where("rn = 1").select("kg_id", "node", place.alias("first")), ["kg_id", "node"])
        of = W.partitionBy("kg_id", "seed")
        met = met.withColumn("place", F.dense_rank().over(of.orderBy("first"))).where(F.col("place") <= limit)
        met = met.withColumn("last", F.max(F.when(F.col("place") == limit, F.col("first"))).over(of)).select("kg_id", "seed", "node", "last")
        hits = best.drop("rn").join(met, ["kg_id", "node"]).where(F.col("last").isNull() | (place <= F.col("last"))).drop("last")
    return seed_top(hits.drop("node").dropDuplicates(["kg_id", "seed", *KEY]), limit, min_conf)


def grouped_facts(hits: DataFrame, docs: int = C.FACT_DOCS) -> DataFrame:
    """Facts by their six fields: greatest confidence, at most `docs` documents, latest creation."""
    return hits.groupBy("kg_id", *FACT).agg(F.max("confidence").alias("confidence"), F.slice(F.array_sort(F.collect_set("source_doc_id")), 1, docs).alias("docs"), F.max("created_at").alias("created_at"))


def top_facts(facts: DataFrame, limit: int = C.FACT_LIMIT) -> DataFrame:
    """The `limit` facts of highest confidence; ties by the fields."""
    return facts.orderBy(F.desc("confidence"), "kg_id", *FACT).limit(limit)


def decayed(facts: DataFrame, now: Column, rate: float = C.DECAY_PER_DAY) -> DataFrame:
    """facts with their decayed score and rank; membership is unchanged."""
    score = F.round(F.col("confidence") * decay(F.col("created_at"), now, rate), 6)
    order = W.partitionBy(F.lit(1)).orderBy(F.desc("score"), F.desc("confidence"), *FACT)  # behind a limit: few rows
    return facts.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def fact_text(labels: dict[str, str] = C.REL_LABELS) -> Column:
    """`s(st) -[label:verb]→ o(ot)` with defaults."""
    rel = F.coalesce(F.col("rel_type"), F.lit("RELATED_TO"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), rel), rel)
    verb, default = F.coalesce("verb", rel), F.lit("概念")
    return F.concat("subject", F.lit("("), F.coalesce("subject_type", default), F.lit(") -["), label, F.lit(":"), verb, F.lit("]→ "), "object", F.lit("("), F.coalesce("object_type", default), F.lit(")"))


def query_facts(edges: DataFrame, entities: DataFrame, terms: list[str], now: Column, hops: int = 2, limit: int = C.FACT_LIMIT, min_conf: int = 1) -> DataFrame:
    """Facts around the entities that the terms name: expansion, per-seed limit, grouping, limit, decay order."""
    seeds = names_containing(entities, terms).select("kg_id", F.col("name").alias("seed"))
    facts = top_facts(grouped_facts(expand_top(edges, seeds, hops, min_conf=min_conf)), limit)
    return decayed(facts, now).withColumn("fact", fact_text())


def provenance_facts(edges: DataFrame, entities: DataFrame, titles: DataFrame, terms: list[str], now: Column, hops: int = 1, limit: int = C.FACT_LIMIT, min_conf: int = 1) -> DataFrame:
    """Ungrouped facts with titles: limit first, then decay order, then the first of each (subject, rel_type, object)."""
    seeds = names_containing(entities, terms).select("kg_id", F.col("name").alias("seed"))
    hits = beside(edges, reach(edges, seeds, hops - 1)).where(F.col("confidence") >= min_conf)
    few = hits.orderBy(F.desc("confidence"), "kg_id", *KEY).limit(limit)
    few = few.withColumn("score", F.round(F.col("confidence") * decay(F.col("created_at"), now), 6))
    first = W.partitionBy("subject", "rel_type", "object").orderBy(F.desc("score"), F.desc("confidence"), "kg_id", "source_doc_id")
    few = few.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    return few.join(titles, "source_doc_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def chains(facts: DataFrame, limit: int = C.CHAINS) -> DataFrame:
    """(first, second, third) over pairs of facts that meet, the third not the first; `limit` in order."""
    a = facts.select(F.col("kg_id"), F.col("subject").alias("first"), F.col("object").alias("second")).distinct()
    b = facts.select("kg_id", F.col("subject").alias("second"), F.col("object").alias("third")).distinct()
    return a.join(b, ["kg_id", "second"]).where("first <> third and first <> second").select("kg_id", "first", "second", "third").distinct().orderBy("kg_id", "first", "second", "third").limit(limit)


def out_degree(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(kg_id, name, degree) of outgoing edges; entities without edges have 0."""
    n = edges.groupBy("kg_id", F.col("subject").alias("name")).agg(F.count("*").alias("degree"))
    return entities.select("kg_id", "name").join(n, ["kg_id", "name"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def degree(edges: DataFrame) -> DataFrame:
    """(kg_id, name, degree) of edges in either direction."""
    ends = edges.select("kg_id", F.explode(F.array("subject", "object")).alias("name"))
    return ends.groupBy("kg_id", "name").agg(F.count("*").alias("degree"))


def orphans(entities: DataFrame, edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Entities without any edge."""
    ends = edges.select("kg_id", F.explode(F.array("subject", "object")).alias("name"))
    out = entities.join(ends, ["kg_id", "name"], "left_anti")
    return out if limit is None else out.orderBy("kg_id", "name").limit(limit)


def entity_pairs(edges: DataFrame) -> DataFrame:
    """(kg_id, a, b) of distinct undirected pairs, a < b."""
    return edges.where("subject <> object").select("kg_id", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()


def neighbours(edges: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """Distinct neighbours of one node with the number of edges to them."""
    out = edges.where(F.col("subject") == name).select("kg_id", F.col("object").alias("neighbour"))
    back = edges.where(F.col("object") == name).select("kg_id", F.col("subject").alias("neighbour"))
    return out.unionByName(back).groupBy("kg_id", "neighbour").agg(F.count("*").alias("edges")).orderBy(F.desc("edges"), "kg_id", "neighbour").limit(limit)
